"""Centroid clustering in whole numbers: bisector tournaments find each vector's nearest centroid exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, load

#: Components of a vector that is kept, units of one, centroids and rounds.
WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Bits of a limb: sums of components of any size are added up limb by limb.
LIMB = 40
_LONG = (1 << 63) - 1


def whole(values: pa.ListArray, width: int = WIDTH, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and floor(scale * x) of their components, exactly.

    Whole numbers are of 64 bits if sign tests and distances among such vectors fit these, else Python's.
    """
    lengths = values.value_lengths().to_numpy(zero_copy_only=False)
    right = np.equal(lengths, width)  # a null vector's length is nan
    flat = values.filter(pa.array(right)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # a null component becomes nan
    fine = np.isfinite(x).all(1)
    x = x[fine]
    right[np.flatnonzero(right)[~fine]] = False
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if small(scaled):
        return right, scaled.astype(np.int64)
    exact = [[math.floor(v) if math.isfinite(v) else int(raw) * scale for v, raw in zip(*row, strict=True)] for row in zip(scaled.tolist(), x.tolist(), strict=True)]
    return right, np.array(exact, object).reshape(-1, width)


def small(x: np.ndarray) -> bool:
    """Whether sums of products of such numbers stay within 64 bits."""
    return not x.size or abs(x).max() < 2**31 / math.sqrt(8.0 * x.shape[1])


class Bracket:
    """Normals and thresholds of the bisecting planes of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, object).reshape(len(centroids), len(centroids[0]) if centroids else 0)
        # of a and b, b is nearer to x just if 2 x.(b - a) > |b|^2 - |a|^2
        normals = 2 * (c[None, :, :] - c[:, None, :])
        squares = (c * c).sum(1)
        thresholds = squares[None, :] - squares[:, None]
        self.small = small(c)
        kind = np.int64 if self.small else object
        self.centroids, self.normals, self.thresholds = (v.astype(kind) for v in (c, normals, thresholds))

    def play(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row: k - 1 linear sign tests, each of which eliminates one; zero favours the smaller number."""
        if x.dtype == object or not self.small:
            x = x.astype(object)
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = (x * self.normals[best, j]).sum(1) - self.thresholds[best, j]
            best = np.where((side > 0).astype(bool), j, best)
        return best

    def distance(self, x: np.ndarray, best: np.ndarray) -> np.ndarray:
        apart = (x if self.small else x.astype(object)) - self.centroids[best]
        return (apart * apart).sum(1)


def limbs(total: int) -> list[int]:
    """A whole number in limbs of one sign, the lowest first."""
    sign, rest, out = (-1 if total < 0 else 1), abs(total), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def _parts(batches: Iterator[pa.RecordBatch], column: int, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 2_000):  # of which normals are gathered at once
            part = batch.slice(begin, 2_000)
            right, x = whole(part.column(column), width, scale)
            if len(x):
                yield part.filter(pa.array(right)), x


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, width: int = WIDTH, scale: int = SCALE) -> list[list[int]]:
    """Of the kept vectors, those of the least sha256 of ``1:<vec_id>``, ties by their components; ``count`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches, 1, width, scale):
            names = ["" if i is None else str(i) for i in part.column(0).to_pylist()]
            hashes = [hashlib.sha256(f"1:{name}".encode()).hexdigest() for name in names]
            # a task needs to pass on only its own least ones
            rows = sorted(zip(hashes, x.tolist(), strict=True))[:count]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([[str(v) for v in r] for _, r in rows], pa.list_(pa.string()))], names=["h", "x"])

    least = vectors.mapInArrow(run, "h string, x array<string>")
    ordered = least.orderBy("h", F.transform("x", lambda v: v.cast("double")), "x").limit(count)
    return [[int(v) for v in r["x"]] for r in ordered.collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], width: int = WIDTH, scale: int = SCALE) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays.

    Tasks add up their own vectors, and pass on a sum a centroid, component and limb.
    """
    bracket = Bracket(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), width), object), np.zeros(len(centroids), np.int64)
        for _, x in _parts(batches, 1, width, scale):
            best = bracket.play(x)
            counts += np.bincount(best, minlength=len(centroids))
            for c in np.unique(best):
                sums[c] += x[best == c].sum(0)
        rows = [(c, i, k, part) for c in range(len(centroids)) for i in range(width) for k, part in enumerate(limbs(int(sums[c, i])))]
        rows += [(c, -1, 0, int(n)) for c, n in enumerate(counts) if n]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["c", "i", "k", "part"])

    sums = vectors.mapInArrow(run, "c long, i long, k long, part long")
    total = sums.groupBy("c", "i", "k").agg(F.sum(F.col("part").cast("decimal(28,0)")).alias("part"))
    counts, new = [0] * len(centroids), [[0] * width for _ in centroids]
    for row in total.collect():  # a row a centroid, component and limb
        if row["i"] < 0:
            counts[row["c"]] = int(row["part"])
        else:
            new[row["c"]][row["i"]] += int(row["part"]) << (LIMB * row["k"])
    return [[v // n for v in sums_] if n else old for sums_, n, old in zip(new, counts, centroids, strict=True)]


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Nearest of ``count`` centroids for the vectors of ``vec_id, embedding`` with ``width`` components.

    Returns ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` a kept vector. Vectors
    that are null, of another width, or hold a null or non-finite component are left out; rows that repeat
    count each. A null vec_id hashes as an empty one. Fewer vectors than centroids make as many centroids as
    vectors; an empty table gives no rows. Components of any size are compared exactly; distances and sums
    that 64 bits can't hold are null. Other columns are not read. What is sent to tasks is one centroid table.
    """
    rows = vectors.select("vec_id", "embedding")
    centroids = first_centroids(rows, count, width, scale)
    for _ in range(rounds):
        centroids = moved(rows, centroids, width, scale)
    bracket = Bracket(centroids)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches, 1, width, scale):
            best = bracket.play(x)
            apart = [int(d) if d <= _LONG else None for d in bracket.distance(x, best)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(apart, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = cut(rows.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"))
    whole_sum = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(28,0)")))
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(whole_sum.alias("total")).collect()}  # a row a centroid
    fits = lambda total: int(total) if total is not None and total <= _LONG else None
    inertia = fits(sum(sums.values())) if None not in sums.values() else None
    each = F.array(*[F.lit(fits(sums.get(c, 0))).cast("long") for c in range(len(centroids))]) if centroids else F.array().cast("array<long>")
    hashes = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return found.select("vec_id", "cluster", "distance", F.get(each, "cluster").alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), F.get(hashes, "cluster").alias("centroid_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(load(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds one after the other, each distance counted out; the method's sign tests have no part in it."""
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range({WIDTH})) AS i FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {CENTROIDS})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""u{k} AS MATERIALIZED (SELECT c, unnest(v) AS y, unnest(range({WIDTH})) AS i FROM c{k}),
d{k} AS (SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM parts JOIN u{k} USING (i) GROUP BY vec_id, c),
a{k} AS MATERIALIZED (SELECT vec_id, arg_min(c, d * {CENTROIDS} + c) AS c, min(d) AS d FROM d{k} GROUP BY vec_id)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM parts JOIN a{k} USING (vec_id) GROUP BY c, i),
c{k + 1} AS MATERIALIZED (SELECT u.c, list(coalesce(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END, y) ORDER BY u.i) AS v FROM u{k} u LEFT JOIN m{k} m ON u.c = m.c AND u.i = m.i GROUP BY u.c)""")
    last = ROUNDS
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} USING (c)"""


ORACLE = _oracle()

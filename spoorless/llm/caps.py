"""Near-duplicate vectors by spherical-cap filters over structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import components, cut, load

COSINE = 0.98
#: A code word is one of some directions, CODES at least, in each of BLOCKS blocks of the dimensions; so that number ** BLOCKS filters.
BLOCKS, CODES = 4, 16
#: Of as many random directions, a vector lies so far towards about PASSED; it passes the filters that lie as far,
PASSED = 10
#: and its nearest LEAST in any case, but no more than its nearest MOST.
LEAST, MOST = 10, 64
#: Vectors of fewer dimensions are first laid into so many.
WIDE = 32
#: Vectors of a filter that are compared in one piece; larger ones are cut into pieces of about this size.
PIECE = 1024


def code_book(dimensions: int, blocks: int = BLOCKS, codes: int = CODES) -> list[np.ndarray]:
    """Random unit directions of each block of the dimensions, the same for every run."""
    rng = np.random.default_rng(20_231 + dimensions)
    sizes = [len(x) for x in np.array_split(np.arange(dimensions), min(blocks, dimensions))]
    book = [rng.standard_normal((codes, k)) for k in sizes]
    return [b / np.linalg.norm(b, axis=1, keepdims=True) for b in book]


def codes_for(vectors: int) -> int:
    """Directions a block, so that filters are as many as vectors at least; the book grows with the table, and buckets don't."""
    codes = CODES
    while codes**BLOCKS < vectors:
        codes *= 2
    return codes


def rotation(dimensions: int) -> np.ndarray:
    """A random isometry into WIDE dimensions at least, the same for every run.

    It keeps all cosines and spreads a vector over the blocks, whichever of its own coordinates hold its mass
    and however few these are.
    """
    wide = max(dimensions, WIDE)
    q, r = np.linalg.qr(np.random.default_rng(20_232 + dimensions).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dimensions]


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that squares neither vanish nor overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def list_decode(vectors: np.ndarray, book: list[np.ndarray], cap: float | None = None, least: int = LEAST, most: int = MOST) -> list[np.ndarray]:
    """Filters that each unit vector passes, in ascending order: those ``cap`` standard deviations towards it, as far as ``least`` and ``most`` allow.

    Blocks are joined one by one; a beginning stays only while the best ends of the remaining blocks
    could still lift it over the threshold, so far fewer than all products are looked at.
    """
    filters = int(np.prod([len(b) for b in book]))
    cap = NormalDist().inv_cdf(1 - min(0.5, PASSED / filters)) if cap is None else cap
    cuts = np.cumsum([b.shape[1] for b in book])[:-1]
    scores = [part @ b.T for part, b in zip(np.split(vectors, cuts, 1), book, strict=True)]
    # of a random code word the score has this spread: each block adds its squared length over its size
    spread = np.sqrt(sum((part**2).sum(1) / b.shape[1] for part, b in zip(np.split(vectors, cuts, 1), book, strict=True)))
    best = np.cumsum(np.stack([s.max(1) for s in scores[::-1]]), 0)[::-1]
    out = []
    for i in range(len(vectors)):
        bound = min(cap * spread[i], best[0, i] - 1e-9)
        while True:
            total, code = np.zeros(1), np.zeros(1, np.int64)
            for k, s in enumerate(scores):
                total = (total[:, None] + s[i]).ravel()
                code = (code[:, None] * s.shape[1] + np.arange(s.shape[1])).ravel()
                rest = best[k + 1, i] if k + 1 < len(scores) else 0.0
                stay = total + rest >= bound
                total, code = total[stay], code[stay]
            if len(code) >= min(least, np.prod([s.shape[1] for s in scores])) or bound < -2:
                break
            bound -= 0.25 * spread[i]
        if len(code) > most:
            code = code[np.argsort(-total, kind="stable")[:most]]
        out.append(np.sort(code))
    return out


def _filters(vectors: DataFrame, codes: int) -> DataFrame:
    """``rid, label, n, dim, embedding, filters`` of ``rid, label, n, embedding``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for batch in batches:
            rows = batch.column("embedding").to_pylist()
            filters = [None] * len(rows)
            for dim in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                if dim not in books:
                    books[dim] = (rotation(dim), code_book(max(dim, WIDE), codes=codes))
                turned, book = books[dim]
                for i, f in zip(at, list_decode(unit_vectors(np.array([rows[i] for i in at])) @ turned, book), strict=True):
                    filters[i] = f
            columns = [batch.column("rid"), batch.column("label"), batch.column("n"), pa.array([len(r) for r in rows], pa.int32()), batch.column("embedding"), pa.array(filters, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "label", "n", "dim", "embedding", "filters"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    return vectors.mapInArrow(run, f"rid long, label {kinds['label']}, n long, dim int, embedding {kinds['embedding']}, filters array<long>")


def _close(cosine: float):
    def closeness(table: pa.Table) -> np.ndarray:
        rows, kind = blocks.lists(table, "embedding"), table.column("kind").to_numpy()
        padded = np.zeros((len(rows), max(map(len, rows))))
        for i, row in enumerate(rows):
            padded[i, : len(row)] = row
        unit = unit_vectors(padded)
        return (unit @ unit.T >= cosine) & (kind[:, None] == kind[None, :])

    return closeness


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, piece: int = PIECE) -> DataFrame:
    """Links of cosine similarity among vectors of equal labels: ``vec_id, n_links, component_id, kept``.

    Input: ``vec_id, embedding, label``. Equal vectors of a label are one class, compared once; a null label
    and a vector that is null, empty, zero or holds null or non-finite components link with nothing and
    are their own component; vectors of unlike lengths don't link. Repeated rows count each, and a vec_id
    with several vectors has a row for each; a null vec_id names a component only if it has no other. An empty
    table gives no rows; other columns are not read. No filter's vectors are gathered: those of a full
    filter are dealt over cells of two pieces, and each pair is counted by the smallest filter it shares.
    """
    rows = embeddings.select("vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite, F.lit(False)))
    good = rows.filter("ok").select("vec_id", "label", "embedding")
    # hot classes are grouped partially before the shuffle; a class has a number of its own, as a vec_id may be repeated
    grouped = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")))
    classes = cut(grouped.withColumn("rid", F.monotonically_increasing_id()))
    coded = cut(_filters(classes.select("rid", "label", "n", "embedding"), codes_for(classes.count())))
    name = F.xxhash64("label", "dim", "filter")  # should two filters share a name, kinds still tell their vectors apart
    each = coded.select("rid", "label", "dim", F.explode("filters").alias("filter")).select("rid", name.alias("bucket"))
    each = cut(each)
    sizes = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    whole = coded.select("rid", "n", "embedding", F.xxhash64("label", "dim").alias("kind"), F.transform("filters", lambda f: F.xxhash64("label", "dim", f)).alias("buckets"))
    dealt = blocks.deal(each, sizes, piece).join(whole, "rid")
    found = cut(blocks.compare(dealt.select("bucket", "cell", "chunk", "rid", "n", "kind", "embedding", "buckets"), _close(cosine)))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    reach = groups.withColumnRenamed("node", "rid")
    names = reach.join(classes.select("rid", "least"), "rid").groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(links, "rid", "left").join(reach.join(names, "component").select("rid", "component_id"), "rid", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))

"""Document fingerprints by winnowing: k-gram hashes, the least of each window, rightmost of equals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, shuffle_width

#: Characters of a k-gram, and k-grams of a window: texts that share GRAM + WINDOW - 1 characters share a hash.
GRAM, WINDOW = 24, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _square(x: np.uint64) -> np.uint64:
    return np.uint64(int(x) ** 2 % 2**64)


def gram_hashes(codes: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of every run of k codes, put together from runs of 1, 2, 4, ...; the whole if it is shorter."""
    k = min(k, len(codes))
    if not k:
        return np.zeros(0, np.uint64)
    out, size, block, width, power = None, 0, codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    while True:
        if k & width:
            n = len(codes) - size - width + 1
            out = block[:n] if out is None else out[:n] * power + block[size : size + n]
            size += width
        if 2 * width > k:
            break
        block = block[:-width] * power + block[width:]
        width, power = 2 * width, _square(power)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnow(hashes: np.ndarray, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes (their high 32 bits) and their positions, in order of position."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # below the hash, the position counts down, so the least key is the rightmost of equal hashes
    key = (hashes & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    w, width = min(w, n), 1
    while 2 * width <= w:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < w:
        key = np.minimum(key[: -(w - width)], key[w - width :])
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(32)).astype(np.int64), (_LOW - (key & _LOW)).astype(np.int64)


def fingerprint(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return winnow(gram_hashes(codes, k), w)


def digest(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    """A short string of a whole fingerprint, hashes and positions."""
    return hashlib.sha256(b"".join(x.tobytes() for x in chosen)).hexdigest()[:32]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Whole fingerprints of ``doc_id, text``: ``doc_id, hashes, positions`` in order of position.

    Null and empty texts have empty arrays; a text shorter than k has one hash, of all of it, at 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", k, w) for t in batch.column(1)]
            arrays = [batch.column(0), *(pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "hashes", "positions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, hashes array<long>, positions array<long>")


def with_neighbour(docs: DataFrame, parts: int) -> DataFrame:
    """Deal ``doc_id, text`` so that each document's next one, by descending id, follows it in its partition.

    Ids are cut into ``parts`` ranges at approximate quantiles (bounded, the only thing the driver
    reads besides one id a range). The first document of a range also goes, as ``tail``, to the end of
    the range before; that of the first range to the end of the last one. Null ids come last; equal ids
    are in order of text.
    """
    key = F.col("doc_id").cast("double")
    bounds = docs.select(key.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    splits = [-float("inf"), *sorted(set(bounds) or {0.0}), float("inf")]
    ranges = len(splits) - 1
    marked = Bucketizer(splits=splits, inputCol="_key", outputCol="_bin", handleInvalid="keep").transform(docs.select("doc_id", "text", key.alias("_key")))
    part = F.when(F.col("_key").isNull(), F.lit(ranges)).otherwise(F.lit(ranges - 1) - F.col("_bin")).cast("int")
    marked = marked.select("doc_id", "text", part.alias("part"))
    heads = sorted((r["part"], r["head"]) for r in marked.groupBy("part").agg(F.max("doc_id").alias("head")).collect())  # a row a range
    if not heads:
        return marked.withColumn("tail", F.lit(False))
    before = [heads[i - 1][0] for i in range(len(heads))]
    moved = docs.sparkSession.createDataFrame([(p, h, b) for (p, h), b in zip(heads, before, strict=True)], f"part int, head {docs.schema['doc_id'].dataType.simpleString()}, before int")
    joined = marked.join(F.broadcast(moved), (marked["part"] == moved["part"]) & marked["doc_id"].eqNullSafe(moved["head"]), "left").select("doc_id", "text", marked["part"], "before")
    places = F.array_compact(F.array(F.struct(F.col("part"), F.lit(False).alias("tail")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(True).alias("tail")))))
    dealt = joined.withColumn("place", F.explode(places)).select("doc_id", "text", "place.part", "place.tail")
    return dealt.repartitionById(ranges + 1, F.col("part")).sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")


def compare_with_next(docs: DataFrame, k: int = GRAM, w: int = WINDOW, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last third comes from the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Null texts are empty; two empty fingerprints are alike (1.0), one is unlike any other (0.0); a single
    document is its own next one; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None  # the document whose next one is awaited

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text, part, tail in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, part = text.as_py() or "", part.as_py()
                if tail.as_py() and (last is None or last[0] != part):
                    continue  # another row of the same id already stood at the end
                chosen = fingerprint(text, k, w)
                now = (part, doc_id.as_py(), text, digest(chosen), np.unique(chosen[0]))
                if last is not None and last[0] == part:
                    _, own_id, own, own_digest, own_set = last
                    cut_off = len(own) // 3
                    edited = own[: len(own) - cut_off] + text[:cut_off]
                    other = fingerprint(edited, k, w)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((own_id, len(own), sha, own_digest, digest(other), likeness(own_set, np.unique(other[0])), likeness(own_set, now[4])))
                    if len(rows) == 1000:
                        yield flush()
                last = None if tail.as_py() else now
        if rows:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = with_neighbour(docs, parts or shuffle_width(docs.sparkSession))
    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(load(spark, sf_dir, "documents"))

"""N-gram Jaccard join by chosen paths: split on sampled shared tokens, compare small buckets, repeat."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import components, cut, load

WORDS, JACCARD = 5, 0.8
#: Length of the MinHash signature whose entries are the tokens to split on.
SIGNATURE = 64
#: Buckets of up to LIMIT sets are compared; larger ones are split again, DEPTH times at most.
LIMIT, DEPTH = 512, 3
#: A node splits on one token, and with this probability on a second: 1 / JACCARD on average.
SECOND = 1 / JACCARD - 1
#: Probability to find a pair at the threshold even if it stands in buckets that are split DEPTH times.
RECALL = 0.99
#: Pairs whose signatures agree less are not verified: six deviations below the threshold.
SIGHT = 0.5
#: Sets of a cell when a bucket is compared in pieces.
PIECE = 512
#: Up to so many documents are looked up by a broadcast of their ids; beyond, by a shuffle.
BROADCAST_IDS = 500_000
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W_]+")


def runs_for(recall: float = RECALL, depth: int = DEPTH, jaccard: float = JACCARD) -> int:
    """Runs until a pair at the threshold is found with probability ``recall``."""
    p = 1.0
    for _ in range(depth):
        stay = jaccard * p
        p = (1 - SECOND) * stay + SECOND * (1 - (1 - stay) ** 2)
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - p))))


class Shingler:
    """Sets of word n-grams as sorted 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.seen: dict[str, int] = {}
        rng = np.random.default_rng(64_901)
        self.a = rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64)

    def set(self, text: str | None) -> np.ndarray:
        """A text of fewer words than n is one n-gram; one without words is the empty set."""
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.uint64)
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(27)))

    def signature(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
        for begin in range(0, len(grams), 4096):
            part = grams[None, begin : begin + 4096] * self.a[:, None] + self.b[:, None]
            low = np.minimum(low, (part ^ (part >> np.uint64(33))).min(1))
        return (low >> np.uint64(33)).astype(np.int32)


def digest(grams: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, size, c1, c2, signature`` of every whole text; c1 and c2 name the set of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.set(t.as_py()) for t in batch.column(1)]
            names = [digest(s) for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)), pa.array([shingler.signature(s) if len(s) else None for s in sets], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "c1", "c2", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size int, c1 long, c2 long, signature array<int>")


def gram_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.set(t.as_py()) for t in batch.column(0)]
            names = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["c1", "c2", "grams"])

    return docs.select("text").mapInArrow(run, "c1 long, c2 long, grams array<long>")


def chosen_paths(sets: DataFrame, runs: int, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """``bucket, rid, size`` of ``rid, signature``: the buckets of several sets at the ends of the paths.

    A node's path decides which entries of the signature it splits on, so all its sets split alike; a
    child holds the sets that agree in that entry.
    """

    def split(frontier: DataFrame) -> DataFrame:
        entry = lambda salt: F.pmod(F.xxhash64("path", F.lit(salt)), F.lit(SIGNATURE)).cast("int")
        second = F.pmod(F.xxhash64("path", F.lit("second")), F.lit(1 << 20)) < int(SECOND * (1 << 20))
        at = F.array_compact(F.array(entry("a"), F.when(second & (entry("a") != entry("b")), entry("b"))))
        child = frontier.select("rid", "path", "signature", F.explode(at).alias("at"))
        return child.select("rid", F.xxhash64("path", "at", F.get("signature", F.col("at"))).alias("path"))

    frontier = sets.select("rid", "signature", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).select("rid", "signature", F.xxhash64(F.lit("run"), "run").alias("path"))
    ends = None
    for level in range(1, depth + 1):
        children = cut(split(frontier))
        sizes = children.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        alive = cut(children.join(sizes, "path").select(F.col("path").alias("bucket"), "rid", "size"))
        done = alive if level == depth else alive.filter(F.col("size") <= limit)
        ends = done if ends is None else ends.union(done)
        open_ = alive.filter(F.col("size") > limit)
        if level == depth or open_.isEmpty():
            break
        frontier = open_.select("rid", F.col("bucket").alias("path")).join(sets.select("rid", "signature"), "rid")
    return ends


def _likely(table: pa.Table, jaccard: float) -> np.ndarray:
    """Pairs that their signatures and sizes don't rule out."""
    m = table.num_rows
    agree = np.zeros((m, m), np.int16)
    for column in np.stack(blocks.lists(table, "signature")).T:
        agree += column[:, None] == column[None, :]
    sizes = table.column("size").to_numpy()
    likely = (agree >= SIGHT * SIGNATURE) & (np.minimum(sizes[:, None], sizes[None, :]) >= jaccard * np.maximum(sizes[:, None], sizes[None, :]))
    np.fill_diagonal(likely, False)
    return likely


def _close(jaccard: float):
    def closeness(table: pa.Table) -> np.ndarray:
        m, sizes, likely = table.num_rows, table.column("size").to_numpy(), _likely(table, jaccard)
        used = np.flatnonzero(likely.any(1))
        close = np.zeros((m, m), bool)
        if not len(used):
            return close
        grams = blocks.lists(table, "grams")
        pool, place = np.unique(np.concatenate([grams[i] for i in used]), return_inverse=True)
        row = np.repeat(np.arange(len(used)), [len(grams[i]) for i in used])
        often = np.bincount(place, minlength=len(pool)) > 1  # n-grams of one set only are shared by none
        rank = np.cumsum(often) - 1
        keep = often[place]
        row, place = row[keep], rank[place[keep]]
        shared = np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        for begin in range(0, int(often.sum()), 4096):
            a, b = np.searchsorted(place, [begin, begin + 4096])
            member = np.zeros((len(used), 4096), np.float32)
            member[row[a:b], place[a:b] - begin] = 1
            shared += member @ member.T
        own = sizes[used].astype(np.float64)
        close[np.ix_(used, used)] = shared >= jaccard * (own[:, None] + own[None, :] - shared) - 1e-9
        np.fill_diagonal(close, False)
        return close & likely

    return closeness


def jaccard_join(docs: DataFrame, words: int = WORDS, jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """Links of Jaccard similarity among documents' sets of word n-grams.

    ``doc_id, text`` in; a row a document out: ``doc_id, class_id`` (the smallest doc_id that links reach,
    its own included), ``copy_id`` (the smallest doc_id of the same set) and ``n_links`` (other documents
    linked directly). Words are lower-cased runs of letters and digits. Equal sets are one class and compared once.
    Texts without words (null, empty) link with nothing, nor do rows without an id. Repeated rows count
    each. An empty table gives no rows; other columns are not read. Buckets that stay large are compared
    in pieces, whole; no pairs are written, only each row's count and the smallest row it reaches.
    """
    signed = cut(signatures(docs, words))
    able = signed.filter((F.col("size") > 0) & F.col("doc_id").isNotNull())
    grouped = able.groupBy("c1", "c2").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n"), F.any_value("size").alias("size"), F.any_value("signature").alias("signature"))
    classes = cut(cut(grouped).withColumn("rid", F.monotonically_increasing_id()))
    ends = chosen_paths(classes.select("rid", "signature"), runs_for(recall, DEPTH, jaccard))
    ends = cut(ends.dropDuplicates(["bucket", "rid"]))
    # sets that no other set of their bucket is like, by signature, are left out before whole sets are sent around
    first = blocks.deal(ends.select("bucket", "rid"), ends.select("bucket", "size").distinct(), PIECE).join(classes.select("rid", F.col("size"), "signature"), "rid")
    ends = cut(blocks.marked(first.select("bucket", "cell", "rid", "size", "signature"), lambda table: _likely(table, jaccard)).distinct())
    sizes = ends.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    buckets = ends.groupBy("rid").agg(F.collect_list("bucket").alias("buckets"))  # a few a run
    wanted = cut(classes.join(buckets, "rid").select("rid", "n", "size", "signature", "buckets", "c1", "c2", "copy_id"))
    named = wanted.select(F.col("copy_id").alias("doc_id")).distinct()
    named = F.broadcast(named) if wanted.count() <= BROADCAST_IDS else named
    grams = gram_sets(docs.select("doc_id", "text").join(named, "doc_id", "left_semi"), words).dropDuplicates(["c1", "c2"])
    whole = wanted.join(grams, ["c1", "c2"]).select("rid", "n", "size", "signature", "buckets", "grams")
    dealt = blocks.deal(ends.select("bucket", "rid"), sizes, PIECE).join(whole, "rid")
    found = cut(blocks.compare(dealt.select("bucket", "cell", "chunk", "rid", "n", "size", "signature", "buckets", "grams"), _close(jaccard)))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"node": "rid"})
    names = reach.join(classes.select("rid", "copy_id"), "rid").groupBy("component").agg(F.min("copy_id").alias("class_id"))
    linked = reach.join(names, "component").select("rid", "class_id").join(links, "rid")
    known = classes.join(linked, "rid", "left").select("c1", "c2", F.col("copy_id"), F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = able.select("doc_id", "c1", "c2").join(known, ["c1", "c2"]).select("doc_id", "class_id", "copy_id", "n_links")
    rest = signed.filter((F.col("size") == 0) | F.col("doc_id").isNull())
    return out.union(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long")))


def keep_one_each(docs: DataFrame, words: int = WORDS, jaccard: float = JACCARD) -> DataFrame:
    """The documents of which class_id is their own doc_id, so one of each group; columns as they are.

    Rows without an id stay. Of rows that share a doc_id all stay or go.
    """
    classes = jaccard_join(docs, words, jaccard)
    drop = classes.filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"))

"""Language-model scoring: a causal self-attention model over subword ids, beside word counts, trained and applied on Spark."""

from __future__ import annotations

import itertools
import math
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import attention, ledger
from .common import load

#: Characters of a block of documents.
BLOCK_CHARS = 16_000_000
#: Words whose ids a Python worker remembers at most, and the bytes of the longest.
REMEMBERED, LONGEST = 500_000, 64
#: Rounds of training, each with windows of its own, after which the workers' models are averaged; windows of a worker in a round, at least.
ROUNDS, SHARD = 4, 20_000
#: Rate of the first round; each round's is a part of the one before.
RATE, SLOWER = 0.015, 0.7
#: Parameters that are averaged in one task.
PART = 8_192


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out() -> F.Column:
    """Documents that nothing is learned from: those of remainder 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A to Z) runs of anything but ASCII white space; an end, '', follows."""
    return [*(text or "").encode().lower().split(), b""]


class Words:
    """Subword ids of words, each by itself; what a Python worker has encoded it remembers, up to a bound."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        self.end = self.pieces.get_piece_size()  # one more id
        self.known: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has; the end has its own."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.get
        found = list(map(get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        for begin in range(0, len(new), 20_000):
            some = new[begin : begin + 20_000]
            for k, ids in zip(some, self.pieces.encode([words[k].decode() for k in some], num_threads=1), strict=True):
                found[k] = array("I", ids if words[k] else [self.end]).tobytes()
                if len(words[k]) <= LONGEST:
                    self.known[words[k]] = found[k]
        return np.frombuffer(b"".join(found), np.uint32).astype(np.int64), np.array(list(map(len, found)), np.int64) // 4


def told_blocks(docs: DataFrame, tokenizer: str, chars: int = BLOCK_CHARS) -> DataFrame:
    """A row a document with its words' slots in order, an entry a word with its training count and subword ids, and a row a block with counts of ids and the ids of all its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for number, rows in ledger.blocks(batches, 1, chars):
            encoder = encoder or Words(tokenizer)
            held, n = rows.column(2).to_numpy(zero_copy_only=False), rows.num_rows
            index: dict[bytes, int] = defaultdict(itertools.count().__next__)
            slots = [np.fromiter(map(index.__getitem__, words(t)), np.int32) for t in rows.column(1).to_pylist()]
            sizes = np.array([len(s) for s in slots], np.int64)
            flat = np.concatenate(slots)
            counts = np.bincount(flat, np.repeat(~held, sizes), len(index)).astype(np.int64)
            own, each = encoder.encode(list(index))
            id_counts = np.bincount(own, np.repeat(counts, each), encoder.end + 1).astype(np.int64)
            starts = np.cumsum(each) - each
            learned = [gathered(own.astype(np.uint32), each, [x for x, h in zip(some, out, strict=True) if not h]) for some, out in zip(in_turns(slots, sizes), in_turns(held, sizes), strict=True) if not out.all()]
            ids, lengths = (np.concatenate([np.zeros(0, kind), *(x[k] for x in learned)]) for k, kind in enumerate((np.uint32, np.int64)))
            known = np.flatnonzero(id_counts)
            pieces = own.astype("<u4").tobytes()
            yield ledger.batch("document", n, {"block": [number] * n, "doc_id": rows.column(0), "held_out": rows.column(2), "slots": [ledger.packed(s) for s in slots]}, fields)
            yield ledger.batch("entry", len(index), {"block": np.full(len(index), number), "slot": np.arange(len(index)), "key": [w.decode() for w in index], "n": counts, "pieces": [pieces[4 * x : 4 * (x + y)] for x, y in zip(starts.tolist(), each.tolist(), strict=True)]}, fields)
            yield ledger.batch("block", 1, {"block": [number], "known": [known], "id_counts": [id_counts[known]], "ids": [ledger.packed(ids)], "lengths": [ledger.packed(lengths)], "n_windows": [int(-(-lengths // attention.WINDOW).sum())], "n": [int(counts.sum())]}, fields)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"what string, block long, doc_id {kind}, held_out boolean, slots binary, slot int, key string, n long, pieces binary, known array<long>, id_counts array<long>, ids binary, lengths binary, n_windows long"
    fields = ledger.fields_of(schema)
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, schema)


def in_turns(values, sizes: np.ndarray, most: int = 500_000) -> list:
    """Values of texts, cut where about so many words are together."""
    bounds = np.searchsorted(np.cumsum(sizes), np.arange(most, int(sizes.sum()), most)) + 1
    edges = np.unique([0, *bounds, len(sizes)])
    return [values[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]


def gathered(own: np.ndarray, each: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts in a row, and how many each has, from the ids of their words."""
    flat, starts = np.concatenate(slots), np.cumsum(each) - each
    n = each[flat]
    ids = attention.rows_of(own, np.repeat(starts[flat] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
    return ids, np.add.reduceat(n, np.cumsum([0, *map(len, slots[:-1])]))  # no text is without an end


class Model:
    """What scoring needs: outputs for ids and the parameters."""

    def __init__(self, counts: np.ndarray):
        self.outputs = attention.Outputs(counts)
        self.parameters = attention.initial(self.outputs)

    def lay(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parameters.values()])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for name, value in self.parameters.items():
            self.parameters[name] = flat[at : at + value.size].reshape(value.shape).astype(np.float32)
            at += value.size

    def lessons(self, ids: bytes, lengths: bytes, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets and what is scored of the windows of one turn over a block's texts; over all turns, each token is a target once."""
        place = self.outputs.place.astype(np.int16)[ledger.unpacked(ids)]
        return attention.framed(place, ledger.unpacked(lengths), self.outputs.count, 0, slice(turn, None, turns))[:3]

    def score(self, own: np.ndarray, each: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text of words with ids; some texts are taken at a time."""
        out, begin, sizes = [], 0, np.cumsum([0, *map(len, slots)])
        while begin < len(slots):
            stop = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + 100_000)) - 1)
            ids, lengths = gathered(own, each, slots[begin:stop])
            out.append(attention.scores(self.parameters, self.outputs, ids, lengths))
            begin = stop
        return np.concatenate(out) / math.log(10) if out else np.zeros(0)


def id_counts(told: DataFrame, size: int) -> np.ndarray:
    """Occurrences of every id in all training documents; as many rows as the vocabulary has ids reach the driver at most."""
    counted = told.filter("what = 'block'").select(F.explode(F.arrays_zip("known", "id_counts")).alias("e")).groupBy(F.col("e.known").alias("id")).agg(F.sum("e.id_counts").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in counted.collect():
        counts[row["id"]] = row["n"]
    return counts


def trained(told: DataFrame, vocabulary: int, rounds: int = ROUNDS, shard: int = SHARD) -> Model:
    """Train on all windows of all blocks: workers each on their own shard, averaged after each round.

    A shard holds ``shard`` windows of a round, or all of a task if it has more, so shards grow in number with the
    corpus. The averages are made in parts of the parameters, and only they, one model's size, reach the driver.
    """
    model = Model(id_counts(told, vocabulary))
    held = told.filter("what = 'block' AND n_windows > 0").select("ids", "lengths", "n_windows")
    total = held.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0]
    if not total:
        return model
    shards = max(1, round(total / rounds / shard))
    for turn in range(rounds):
        rate = RATE * SLOWER**turn

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model.__new__(Model)
            own.outputs, own.parameters = model.outputs, {k: v.copy() for k, v in model.parameters.items()}
            parts = [own.lessons(ids.as_py(), lengths.as_py(), turn, rounds) for batch in batches for ids, lengths in zip(batch.column(0), batch.column(1), strict=True)]
            if not parts:
                return
            inputs, targets, scored = (np.concatenate(x) for x in zip(*parts, strict=True))
            attention.train(own.parameters, inputs, targets, scored, rate, seed=turn)
            flat = own.lay()
            pieces = [flat[k : k + PART] for k in range(0, len(flat), PART)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([float(scored.sum())] * len(pieces), pa.float64()), pa.array(pieces, pa.list_(pa.float32()))], names=["part", "weight", "flat"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Weighted sums of a task's parts; a task holds one of each."""
            sums: dict[int, list] = {}
            for batch in batches:
                for part, weight, flat in zip(*(batch.column(c) for c in ("part", "weight", "flat")), strict=True):
                    value = np.asarray(flat.values, np.float64) * weight.as_py()
                    old = sums.setdefault(part.as_py(), [0.0, np.zeros(len(value))])
                    old[0] += weight.as_py()
                    old[1] += value
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([w for w, _ in sums.values()], pa.float64()), pa.array([v for _, v in sums.values()], pa.list_(pa.float64()))], names=["part", "weight", "flat"])

        # blocks stay where they were written; tasks are put together, without a shuffle, where they are too many
        models = held.select("ids", "lengths").coalesce(shards).mapInArrow(work, "part int, weight double, flat array<float>")
        sums = models.repartition("part").mapInArrow(average, "part int, weight double, flat array<double>")
        rows = sorted(sums.collect(), key=lambda r: r["part"])  # one model
        if any(r["weight"] for r in rows):
            model.take(np.concatenate([np.array(r["flat"]) / r["weight"] for r in rows]))
    return model


def scored(docs: DataFrame, tokenizer: str | None = None, share: float = 1.0, rounds: int = ROUNDS, shard: int = SHARD, chars: int = BLOCK_CHARS) -> DataFrame:
    """Score every whole text of ``doc_id, text``, learning from those that are not held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. The base counts words
    of all training texts, each and the end once more than seen; the score is of a self-attention model over
    the words' subword ids, trained on all windows of all training texts; ``share`` can be nothing but 1. Null texts are empty and have
    their end only. Null doc_ids are learned from. Rows that repeat count each. Without training texts, every
    token has the base's 1 / 1, score 0, and the model stays as it begins. Other columns are not read; an
    empty table gives no rows.
    """
    if share != 1:
        raise ValueError("the model learns from all training texts")
    path = tokenizer or default_tokenizer()
    told = ledger.written(told_blocks(docs, path, chars))
    same = Window.partitionBy("key")
    # one shuffle: each block's entry of a word gets the word's count, and the first of them stands for the word
    first = (F.min("block").over(same) == F.col("block")).alias("first")
    known = ledger.written(ledger.entries(told, "pieces").select("block", "slot", "pieces", F.sum("n").over(same).alias("c"), first))
    n = told.filter("what = 'block'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    v = known.filter("first AND c > 0").count()
    model = trained(told, Words(path).end + 1, rounds, shard)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        found = found.take(np.argsort(found.column("slot").to_numpy()))
        count, pieces = found.column("c").to_numpy(), found.column("pieces").to_pylist()
        log = np.log10(count + 1) - math.log10(n + v + 1)
        texts: dict[bytes, int] = {}
        at = [texts.setdefault(x, len(texts)) for x in rows.column("slots").to_pylist()]  # equal texts of a block are scored once
        slots = [ledger.unpacked(x) for x in texts]
        own = np.frombuffer(b"".join(pieces), "<u4").astype(np.int64)
        told = {
            "n_tokens": [len(s) for s in slots], "n_known": [int((count[s] > 0).sum()) for s in slots], "train_tokens": [n] * len(slots),
            "base_score": [float(log[s].sum()) for s in slots], "score": model.score(own, np.array([len(x) // 4 for x in pieces], np.int64), slots).tolist(),
        }
        more = {c: pa.array([x[k] for k in at], pa.float64() if "score" in c else pa.int64()) for c, x in told.items()}
        return pa.table({c: more[c] if c in more else rows.column(c) for c in names})

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ledger.looked_up(told.select("what", "block", "doc_id", "held_out", "slots", "slot", "key", "n"), known.select("block", "slot", "pieces", "c"), finish, schema)


def op12_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(load(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))

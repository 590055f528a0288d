"""Best-fit packing of token pieces: configuration LP, multiplicative weights, knapsack pricing, rounding."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, load, shuffle_width

CAPACITY = 2048
END_ID = 0
#: Rounds of multiplicative weights. Each adds one configuration.
ROUNDS = 128
#: Chunks of text whose ids a Python worker remembers at most, and the longest that it remembers.
REMEMBERED, LONGEST = 700_000, 64
#: Characters of text taken apart at a time.
SLICE = 1_000_000

_LATIN, _RUN = re.compile("[\x00-\u012f\u0131-\u024f]*"), re.compile(r"[.,](?<=[\W\d_][.,])[ \n]")
_ALONE = (". ", ", ", ".\n", ",\n")
_SEPARATORS, _SPACE = re.compile(r"[\x1c-\x1f]"), re.compile(r"[ \t\r\n]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Token ids of texts by way of their white-space-separated chunks, as little-endian bytes.

    The tokenizer drops white space and neither its normaliser nor its splitting looks across it, so a
    text's ids are those of its chunks in turn; chunks repeat, and are looked up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.marks = {mark: self._each([mark])[0] for mark in (".", ",")}

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case Latin words: some dozens are encoded together and told apart by their word ends."""
        found: list[bytes] = []
        groups = [words[i : i + 64] for i in range(0, len(words), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(stops) == len(group):
                raw, ends = ids.tobytes(), stops.tolist()
                found += [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            else:
                found += self._each(group)
        return found

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        known = self.known
        words = [c for c in chunks if c.isalpha() and c.islower() and len(c) <= LONGEST and (c.isascii() or max(c) < "ɐ")]
        found = dict(zip(words, self._words(words), strict=True))
        rest = list(chunks.difference(found))
        # a Latin word in other case, or before a full stop or comma
        odd, bare = [], {}
        for chunk in rest:
            word, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in ".," else (chunk, "")
            if word.isalpha() and max(word) < "ɐ" and "İ" not in word and len(word) <= LONGEST:
                bare[chunk] = (word.lower(), mark)
            else:
                odd.append(chunk)
        new = list({word for word, _ in bare.values()}.difference(known, found))
        found.update(zip(new, self._words(new), strict=True))
        for chunk, (word, mark) in bare.items():
            ids = found[word] if word in found else known[word]
            found[chunk] = ids + self.marks[mark] if mark else ids
        found.update(zip(odd, self._each(odd), strict=True))
        return found

    def _chunks(self, text: str) -> list[str]:
        # Python also splits at U+001C to U+001F, which the tokenizer doesn't count as white space
        if _SEPARATORS.search(text):
            return [c for c in _SPACE.split(text) if c]
        if _LATIN.fullmatch(text) and not _RUN.search(text):
            # a mark between a letter and white space is a token of its own, and case is dropped: fewer chunks
            text = text.lower()
            for mark in _ALONE:
                text = text.replace(mark, f" {mark}")
        return text.split()

    def _encode(self, parts: list[list[str]]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        ids = [list(map(known.get, chunks)) for chunks in parts]
        short = [k for k, x in enumerate(ids) if None in x]
        if short:
            new = self._learn({c for k in short for c, x in zip(parts[k], ids[k], strict=True) if x is None})
            known.update(new)
            for k in short:
                ids[k] = [known[c] for c in parts[k]]
            for chunk in [c for c in new if len(c) > LONGEST]:
                del known[chunk]
        return [b"".join(x) for x in ids]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; some texts, or a part of one at a white space, are taken at a time."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) > SLICE:
                yield from self._encode(group)
                group, size, out, begin = [], 0, [], 0
                while begin < len(text):
                    stop = text.find(" ", begin + SLICE)
                    stop = len(text) if stop < 0 else stop
                    out += self._encode([self._chunks(text[begin:stop])])
                    begin = stop
                yield b"".join(out)
                continue
            group.append(self._chunks(text))
            size += len(text)
            if size > SLICE:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize ``doc_id, text`` whole and cut what is longer than ``capacity``.

    One row a piece: ``doc_id, piece, start, length, ids_crc32``. Null text is empty; an empty text is one
    piece of one id, the end mark. Each text is one row of Arrow data; a task keeps one text's ids at a time.
    """
    path = tokenizer or default_tokenizer()
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or ChunkEncoder(path)
            rows: list[list] = [[], [], [], [], []]
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0), encoder.encode(texts), strict=True):
                ids += END_ID.to_bytes(4, "little")
                for piece, begin in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[begin : begin + 4 * capacity]
                    for column, value in zip(rows, (doc_id.as_py(), piece, begin // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=list(names))

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _priciest(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: the multiset of lengths of the highest total price that fits."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    reach = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room], last[room] = best[room - 1], -1
        if k := reach[room]:
            gain = best[room - lengths[:k]] + prices[:k]
            if gain[i := int(gain.argmax())] > best[room]:
                best[room], last[room] = gain[i], i
    counts, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if (i := last[room]) < 0:
            room -= 1
        else:
            counts[i] += 1
            room -= lengths[i]
    return counts


def fractional_configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Approximate solution of the configuration LP: (counts of each length, how often), by multiplicative weights.

    Each round prices every length by its weight over its demand, takes the configuration that the
    knapsack finds, and lowers the weights of the lengths that it covers.
    """
    volume = float((lengths * demand).sum()) / capacity
    step, rate = volume / rounds, 6.0
    covered = np.zeros(len(lengths))
    found: dict[bytes, list] = {}
    for _ in range(rounds):
        weights = np.exp(-rate * np.minimum(covered, 50.0))
        # a length's price never falls below a trace of its volume, so that room isn't left empty
        config = _priciest(lengths, weights / demand + 1e-9 * lengths / (lengths @ demand), capacity)
        config = np.minimum(config, demand)
        covered += config * step / demand
        found.setdefault(config.tobytes(), [config, 0.0])[1] += step
    return [(config, times) for config, times in found.values()]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[list[tuple[int, int]], int]]:
    """Whole configurations that hold exactly the histogram's pieces: ([(length, count), ...], times).

    The LP's configurations are taken floor(times) times as far as pieces last, each topped up with the
    longest pieces that fit, while that fills them; what is left is packed longest first in the same way. Each entry of the
    result uses up a length or a configuration, so there are at most as many as both, however many pieces.
    """
    left = {length: n for length, n in histogram.items() if n}
    plan: list[tuple[list[tuple[int, int]], int]] = []
    there = sum(1 << length for length in left)  # the lengths of which pieces are left, as bits

    def fill(config: dict[int, int]) -> dict[int, int]:
        """The configuration as far as pieces last, topped up with the longest that fit."""
        config = {length: min(n, left[length]) for length, n in config.items() if length in left}
        room, open_ = capacity - sum(length * n for length, n in config.items()), there
        for length, n in config.items():
            open_ &= ~((left[length] <= n) << length)
        while fitting := open_ & ((1 << (room + 1)) - 1):
            length = fitting.bit_length() - 1
            more = min(room // length, left[length] - config.get(length, 0))
            config[length] = config.get(length, 0) + more
            room -= more * length
            open_ &= ~(1 << length)
        return config

    def take(config: dict[int, int], most: int | None) -> int:
        nonlocal there
        times = min(left[length] // n for length, n in config.items())
        times = times if most is None else min(times, most)
        for length, n in config.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
                there &= ~(1 << length)
        plan.append((sorted(config.items(), reverse=True), times))
        return times

    if left:
        lengths = np.array(sorted(left), np.int64)
        demand = np.array([left[int(k)] for k in lengths], np.int64)
        for config, times in sorted(fractional_configurations(lengths, demand, capacity, rounds), key=lambda x: -x[1]):
            todo = int(times)
            while todo > 0:
                full = fill({int(lengths[i]): int(config[i]) for i in np.flatnonzero(config)})
                if sum(length * n for length, n in full.items()) < capacity:
                    break  # only configurations without room left are taken before the rest is seen
                todo -= take(full, todo)
    while left:
        take(fill({there.bit_length() - 1: 1}), None)
    return plan


def place(pieces: DataFrame, plan: list[tuple[list[tuple[int, int]], int]]) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset`` under a plan made from the pieces' histogram.

    Pieces of a length are numbered in salted groups with offsets, so no length is gathered in one task.
    The plan, whose size is bounded by the number of different lengths, goes to the tasks as arrays.
    """
    segments, taken, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for length, count in config:
            begin = taken.get(length, 0)
            segments.append((length, begin, count, sequence, offset))
            taken[length] = begin + count * times
            offset += count * length
        sequence += times
    table = np.array(sorted(segments), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    salts = 4 * shuffle_width(pieces.sparkSession)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_own", F.row_number().over(own)).join(offsets, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_own") - 1).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            copy, turn = np.divmod(rank - row[:, 1], row[:, 2])
            columns = [*batch.columns[:5], pa.array(row[:, 3] + copy), pa.array(row[:, 4] + turn * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:5])
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Pack documents of ``doc_id, text`` into as few sequences of ``capacity`` tokens as found.

    Returns a row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null text is
    empty, repeated rows are packed each, an empty table gives no rows; other columns are not read.
    """
    pieces = cut(pieces_of(docs, tokenizer, capacity))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row a length
    return place(pieces, plan_sequences(histogram, capacity, rounds))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))

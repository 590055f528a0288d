"""Cross-tokenizer alignment: both tokenizers' ends merged along a merge path cut into equal pieces."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger
from .common import load

#: Merge steps of a piece.
PIECE = 128
#: Chunks of text whose tokens a Python worker remembers at most, and the longest that it remembers.
REMEMBERED, LONGEST = 600_000, 64

_BETWEEN = re.compile(r"(?<=\S)(?=[ \n])")
_SEPARATORS = np.frombuffer(b",|;", np.uint8).astype(np.uint64)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Tokens of two tokenizers for texts, by way of chunks that neither looks across; chunks repeat, and are looked up.

    A is byte-level and splits before white space. No piece of B goes on past a space or a new line, or
    else texts are taken whole. A chunk whose tokens don't give back its bytes sends its text to be taken whole.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id("▁")
        self.apart = not any(re.search("[^▁]▁|.\n|\n.", p, re.DOTALL) for p in pieces)
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.counts: tuple[list[int], list[int]] = ([], [])
        self.good: list[bool] = []

    def _b_ids(self, chunks: list[str]) -> list[list[int] | None]:
        """B puts a space before what it gets, so that of a chunk is left out; before another chunk it is a token of its own."""
        out = []
        for chunk, ids in zip(chunks, self.b.encode([c[1:] if c[:1] == " " else c for c in chunks], num_threads=1), strict=True):
            if chunk[:1] == " ":
                out.append(ids)
            else:
                out.append(ids[1:] if ids[:1] == [self.mark] else None)
        return out

    def _learn(self, chunks: list[str], remember: bool = True) -> int:
        """Append chunks to the table; returns the place of the first."""
        first = len(self.good)
        for begin in range(0, len(chunks), 10_000):
            part = chunks[begin : begin + 10_000]
            a_ids = [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)]
            b_ids = self._b_ids(part)
            for chunk, a, b in zip(part, a_ids, b_ids, strict=True):
                raw = chunk.encode()
                self.good.append(b is not None and b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw)
                self.counts[0].append(len(a))
                self.counts[1].append(len(b or []))
            for table, ids in zip(self.ids, (a_ids, b_ids), strict=True):
                table.append(np.array([i for x in ids for i in x or []], np.int64))
        if remember:
            self.at.update({c: first + k for k, c in enumerate(chunks) if len(c) <= LONGEST})
        return first

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B for all texts in a row, and how many of each a text has; none if it is null, empty or not given back."""
        if len(self.good) > REMEMBERED:
            self._forget()
        parts = [(_BETWEEN.split(f" {t}") if self.apart else [f" {t}"]) if t else [] for t in texts]
        new = list({c for chunks in parts for c in chunks}.difference(self.at))
        long = {c: k for k, c in enumerate(new, self._learn(new)) if len(c) > LONGEST} if new else {}
        at = [[long[c] if k is None else k for c, k in zip(chunks, map(self.at.get, chunks), strict=True)] if long else list(map(self.at.get, chunks)) for chunks in parts]
        bad = {k for k, ok in enumerate(self.good) if not ok}
        if bad:
            for k, chunks in enumerate(at):
                if not bad.isdisjoint(chunks):
                    place = self._learn([f" {texts[k]}"], False)
                    at[k] = [place] if self.good[place] else []
        sizes = np.array([len(chunks) for chunks in at], np.int64)
        flat = np.fromiter((k for chunks in at for k in chunks), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        out = []
        for table, counts in zip(self.ids, self.counts, strict=True):
            if len(table) > 1:
                table[:] = [np.concatenate(table)]
            n = np.array(counts, np.int64)
            starts = np.cumsum(n) - n
            each = n[flat]
            # the ids of chunk after chunk: each place is its chunk's start and the way into it
            places = np.repeat(starts[flat] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            out.append(table[0][places] if len(places) else np.zeros(0, np.int64))
            out.append(np.bincount(owner, each, len(texts)).astype(np.int64))
        return out[0], out[2], out[1], out[3]


def cuts(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two sorted arrays crosses every ``piece``-th diagonal, by binary search on each.

    On the path, of equal values that of ``a`` comes first.
    """
    d = np.arange(0, len(a) + len(b), piece)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # in the open ones, b's place before the diagonal is there
        ahead = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(d - 1 - middle, 0, len(b) - 1)])
        low, high = np.where(ahead, middle + 1, low), np.where(open_ & ~ahead, middle, high)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places whose ranges overlap, in order, and whether both end there; of ends that both reach the same last.

    All pieces of the merge path walk at once, each its own steps: an overlap is where the next end of
    either falls. The step of ``b`` after equal ends has no width, so it emits nothing.
    """
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    i, j = cuts(a, b, piece)
    shape = (len(i), piece)
    at_a, at_b, said = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
    starts = np.concatenate(([0], a))
    more_a, more_b = np.append(a, a[-1] + 1), np.append(b, b[-1] + 1)
    for step in range(piece):
        end_a, end_b = more_a[i], more_b[j]
        at_a[:, step], at_b[:, step], said[:, step] = i, j, (starts[i] < end_b) & (i < len(a)) & (j < len(b))
        takes = end_a <= end_b
        i, j = np.minimum(i + takes, len(a)), np.minimum(j + ~takes, len(b))
    # the last piece may be shorter than its steps
    said[-1, len(a) + len(b) - piece * (len(said) - 1) :] = False
    of_a, of_b = at_a[said], at_b[said]  # pieces stitched in order
    return of_a, of_b, a[of_a] == b[of_b]


@functools.cache
def decimals(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 to ``count - 1``, first one lowest, in eight bytes; and how many each has."""
    shown = np.array([str(k) for k in range(count)], "S8")
    return shown.view("<u8"), np.char.str_len(shown).astype(np.int64)


def group_strings(a_ids: np.ndarray, b_ids: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text, from the marks of the last tokens of groups."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    # a group's tokens of A stand before its own of B
    place_a = np.arange(len(a_ids)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(b_ids)) + np.cumsum(in_a)[group_b]
    ids, marks = np.zeros(len(a_ids) + len(b_ids), np.int64), np.zeros(len(a_ids) + len(b_ids), np.int64)
    ids[place_a], ids[place_b] = a_ids, b_ids
    marks[place_a], marks[place_b] = last_a * 1, last_b * 2
    names, digits = decimals(1 << (int(ids.max()) if len(ids) else 0).bit_length())
    ends = np.cumsum(digits[ids] + 1)
    # a number of up to seven digits and its separator in eight bytes, of which those unused are left out
    wide = (names[ids] | (_SEPARATORS[marks] << (8 * digits[ids]).astype(np.uint64))).view(np.uint8)
    text = wide[wide != 0]
    raw, stops = text.tobytes(), np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n_a + n_b)))]
    return [raw[x : max(x, y - 1)] for x, y in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


def align(pair: Pair, texts: list[str | None], piece: int = PIECE) -> dict[str, np.ndarray | list]:
    """Of each text its counts and the string of its groups; of all links their text and the ids of A and B."""
    a_ids, b_ids, n_a, n_b = pair.encode(texts)
    # all texts in a row: each ends where both end
    ends_a, ends_b = np.cumsum(pair.a_lengths[a_ids]), np.cumsum(pair.b_lengths[b_ids])
    of_a, of_b, tie = overlaps(ends_a, ends_b, piece)
    text = np.repeat(np.arange(len(texts)), n_a)[of_a]
    last_a, last_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    last_a[of_a[tie]], last_b[of_b[tie]] = 1, 1
    count = lambda rows: np.bincount(rows, minlength=len(texts))
    return {"n_a": n_a, "n_b": n_b, "n_groups": count(text[tie]), "n_links": count(text), "groups": group_strings(a_ids, b_ids, last_a, last_b, n_a, n_b), "text": text, "a": a_ids[of_a], "b": b_ids[of_b]}


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_blocks(docs: DataFrame, tokenizers: tuple[str, str] | None = None, piece: int = PIECE, chars: int = ledger.BLOCK_CHARS) -> DataFrame:
    """A row a document, with its links as slots of its block's id pairs and how often it has each; and an entry for each of these pairs."""
    a_path, b_path = tokenizers or default_tokenizers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for number, rows in ledger.blocks(batches, 1, chars):
            pair = pair or Pair(a_path, b_path)
            n, found = rows.num_rows, align(pair, rows.column(1).to_pylist(), piece)
            keys, slot = np.unique((found["a"] << 32) | found["b"], return_inverse=True)
            each, times = np.unique(found["text"] * max(1, len(keys)) + slot, return_counts=True)
            owner, slot = np.divmod(each, max(1, len(keys)))
            bounds = np.searchsorted(owner, np.arange(n + 1))
            hashed = [hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]]
            pick = lambda v: [ledger.packed(v[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            document = {"block": [number] * n, "doc_id": rows.column(0), **{c: found[c] for c in _COUNTS}, "groups_sha256": hashed, "slots": pick(slot), "times": pick(times)}
            yield ledger.batch("document", n, document, fields)
            entry = {"block": np.full(len(keys), number), "slot": np.arange(len(keys)), "key": keys, "n": np.bincount(slot, minlength=len(keys))}
            yield ledger.batch("entry", len(keys), entry, fields)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"what string, block long, doc_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, slots binary, times binary, slot int, key long, n long"
    fields = ledger.fields_of(schema)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(told: DataFrame) -> DataFrame:
    """``key, count, best`` of all linked id pairs: how many documents hold it, and whether no other of its A id has more."""
    totals = ledger.entries(told).groupBy("key").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("key", 32))
    most = totals.groupBy("a").agg(F.max("count").alias("most"))
    return totals.join(most, "a").select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, tokenizers: tuple[str, str] | None = None, piece: int = PIECE, chars: int = ledger.BLOCK_CHARS) -> DataFrame:
    """Align the tokens of a byte-level tokenizer (A, a space before the text) and a sentence-piece one (B) in every ``doc_id, text``.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. Groups end where both
    tokens end; links are the overlapping pairs of occurrences; an id pair counts a document once, however
    often it links there. Texts that are null, empty or not given back by both have zeros and ''. Special
    tokens' strings are plain text. Rows that repeat are documents of their own, null ids too. A text of any
    length is merged whole, in equal pieces. Other columns are not read; an empty table gives no rows.
    """
    told = ledger.written(aligned_blocks(docs, tokenizers, piece, chars))
    counts = pair_counts(told)
    found = ledger.entries(told).select("block", "slot", "key").join(counts, "key").select("block", "slot", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]

    def finish(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        slot = pairs.column("slot").to_numpy()
        count[slot], best[slot] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        n_best, count_sum = [], []
        for slots, times in zip(rows.column("slots"), rows.column("times"), strict=True):
            at, n = ledger.unpacked(slots.as_py()), ledger.unpacked(times.as_py())
            n_best.append(int(best[at] @ n))
            count_sum.append(int(count[at] @ n))
        more = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table({c: more[c] if c in more else rows.column(c) for c in names})

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in [*_COUNTS, 'n_best', 'count_sum'])}, groups_sha256 string"
    return ledger.looked_up(told, found, finish, schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(load(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))

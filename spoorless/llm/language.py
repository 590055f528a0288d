"""Language identification: known words by log frequency, unseen ones by shorter and shorter n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import letter_runs, load

#: The bounded sample that the model is fitted on: the most frequent languages, and labelled documents of each, about.
LANGUAGES, FIT_DOCUMENTS = 200, 1_000
#: Longest n-gram of a word between its edge marks.
LONGEST = 5
#: A document's evidence is that of so many of its average words at most, so that scores stay graded.
WORDS_COUNTED = 24.0
#: Words that a Python worker remembers at most, and the numbers of which the evidence of unseen ones may consist.
REMEMBERED, NUMBERS = 250_000, 8_000_000
#: Documents below this score are rejected by the filter.
ACCEPTED = 0.5
UNDETERMINED = "und"


def grams_of(word: str, size: int) -> list[str]:
    """Runs of ``size`` characters of a word between its edge marks, without those of marks alone."""
    marked = f"^{word}$"
    return [g for i in range(len(marked) - size + 1) if (g := marked[i : i + size]) not in "^$"]


def name_of(text: str) -> int:
    """The 64-bit hash by which words and n-grams are known, the same as the engine's own of a string."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)


class Places:
    """Places of entries by the hashes of their texts, which are sorted."""

    def __init__(self, names: np.ndarray):
        self.names = names

    def many(self, texts: list[str]) -> np.ndarray:
        """The place of each text, or -1."""
        wanted = np.fromiter(map(name_of, texts), np.uint64, len(texts))
        if not len(self.names):
            return np.full(len(texts), -1)
        at = np.minimum(np.searchsorted(self.names, wanted), len(self.names) - 1)
        return np.where(self.names[at] == wanted, at, -1)

    def __getitem__(self, text: str) -> int:
        return int(self.many([text])[0])


class Rows:
    """Rows by language of which only the languages that an entry was seen in are held; all others are alike."""

    def __init__(self, starts: np.ndarray, languages: np.ndarray, more: np.ndarray, base: np.ndarray):
        self.starts, self.languages, self.more, self.base = starts, languages, more, base
        # centred for each entry: only the differences between languages count
        sums = np.concatenate(([0.0], np.cumsum(more, dtype=np.float64)))[starts]
        self.mean = (np.diff(sums) / max(1, len(base))).astype(np.float32)

    def total(self, places: np.ndarray) -> np.ndarray:
        """The sum of some rows."""
        begin, n = self.starts[places], self.starts[places + 1] - self.starts[places]
        held = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        seen = np.bincount(self.languages[held], self.more[held], len(self.base))
        return len(places) * self.base + seen - self.mean[places].sum(dtype=np.float64)

    def totals(self, places: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
        """The sums of the rows of each of ``count`` owners."""
        begin, n, of = self.starts[places], self.starts[places + 1] - self.starts[places], len(self.base)
        held = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        seen = np.bincount(np.repeat(owners, n) * of + self.languages[held], self.more[held], count * of).reshape(count, of)
        return seen + np.bincount(owners, minlength=count)[:, None] * self.base - np.bincount(owners, self.mean[places], count)[:, None]

    def __getitem__(self, place: int) -> np.ndarray:
        return self.total(np.array([place]))


class Table:
    """Smoothed log frequencies by language of entries, from (hash, language, count) triples in any order."""

    def __init__(self, names: np.ndarray, languages: np.ndarray, counts: np.ndarray, of: int):
        order = np.lexsort((languages, names))
        names, languages, counts = names[order], languages[order], counts[order]
        fresh = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
        self.rows = Places(names[fresh])
        totals = np.bincount(languages, counts, of)
        base = -np.log(totals + 0.1 * max(1, len(fresh)))
        base -= base.sum() / max(1, of)
        self.logs = Rows(np.append(fresh, len(names)), languages.astype(np.uint16), np.log1p(counts * 10.0).astype(np.float32), base)


class Backoff:
    """Log frequencies of words and, for n = LONGEST to 1, of n-grams, by language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        triples: list[dict[tuple[int, int], int]] = [defaultdict(int) for _ in range(LONGEST + 1)]
        for k, language in enumerate(sorted(counts)):
            for word, count in counts[language].items():
                triples[0][name_of(word), k] += count
                for size in range(1, LONGEST + 1):
                    for gram in grams_of(word, size):
                        triples[size][name_of(gram), k] += count
        self._tell(sorted(counts), [(np.array([n for n, _ in t], np.uint64), np.array([k for _, k in t], np.int64), np.array(list(t.values()), np.float64)) for t in triples])

    @classmethod
    def of(cls, languages: list[str], triples: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Backoff:
        """From triples of words, and of 1-grams to LONGEST-grams."""
        model = cls.__new__(cls)
        model._tell(languages, triples)
        return model

    def _tell(self, languages: list[str], triples: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.languages = languages
        self.words, *self.grams = [Table(*t, len(languages)) for t in triples]

    def evidence(self, word: str) -> np.ndarray | None:
        """Of a known word its own; else the mean over its longest n-grams of which any are known."""
        at = self.words.rows[word]
        return self.words.logs[at] if at >= 0 else self.guess(word)

    def guess(self, word: str) -> np.ndarray | None:
        rows, said = self.guesses([word])
        return rows[0] if said[0] else None

    def guesses(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The mean over each word's longest n-grams of which any are known; and whether there are any."""
        out, said = np.zeros((len(words), len(self.languages)), np.float32), np.zeros(len(words), bool)
        for size in range(LONGEST, 0, -1):
            table, left = self.grams[size - 1], np.flatnonzero(~said)
            grams = [grams_of(words[k], size) for k in left.tolist()]
            place = table.rows.many([g for some in grams for g in some])
            owner = np.repeat(np.arange(len(left)), np.fromiter(map(len, grams), np.int64, len(grams)))[place >= 0]
            n = np.bincount(owner, minlength=len(left))
            sums = table.logs.totals(place[place >= 0], owner, len(left))
            out[left[n > 0]] = sums[n > 0] / n[n > 0][:, None]
            said[left[n > 0]] = True
        return out, said


class Judge:
    """Language and score of texts; where a word is known, or its evidence where it isn't, is remembered."""

    def __init__(self, model: Backoff, remembered: int = REMEMBERED):
        self.model = model
        # what is remembered of unseen words has a number a language
        self.most, self.most_unseen = remembered, max(1, min(remembered, NUMBERS // max(1, len(model.languages))))
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}  # place of a known word, or -1 - k for row k of the table
        self.table = np.zeros((1024, len(self.model.languages)), np.float32)  # row 0: words that say nothing
        self.used = 1

    def _learn(self, words: list[str]) -> None:
        self.at.update(zip(words, self.model.words.rows.many(words).tolist(), strict=True))
        unseen = [w for w in words if self.at[w] < 0]
        step = max(1, 4_000_000 // max(1, len(self.model.languages)))
        for begin in range(0, len(unseen), step):
            some = unseen[begin : begin + step]
            rows, said = self.model.guesses(some)
            while self.used + len(rows) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + int(said.sum())] = rows[said]
            place = np.where(said, -self.used - np.cumsum(said), -1)
            self.at.update(zip(some, place.tolist(), strict=True))
            self.used += int(said.sum())

    def learn(self, words: set[str]) -> None:
        """Remember what isn't yet, of some texts' words at once."""
        new = words.difference(self.at)
        if len(self.at) + len(new) > self.most or self.used + len(new) > self.most_unseen:
            self._forget()
            new = words
        if new:
            self._learn(sorted(new))

    def _places(self, words: list[str]) -> np.ndarray:
        found = list(map(self.at.get, words))
        if None in found:
            self.learn(set(words))
            found = list(map(self.at.__getitem__, words))
        return np.array(found, np.int64)

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Of some texts; the words of about a million characters are learned together."""
        out, begin, sizes = [], 0, np.cumsum([0, *(len(t or "") for t in texts)])
        while begin < len(texts):
            stop = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + 1_000_000)) - 1)
            some = [letter_runs((t or "").lower()) for t in texts[begin:stop]]
            if stop > begin + 1:  # a very long text is learned in parts
                self.learn({w for words in some for w in words})
            out += map(self.judge, some)
            begin = stop
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(letter_runs((text or "").lower()))

    def judge(self, words: list[str]) -> tuple[str, float]:
        languages = self.model.languages
        if not words or not languages:
            return UNDETERMINED, 0.0
        total, weight = np.zeros(len(languages)), 0
        for begin in range(0, len(words), 16_384):  # a very long text in parts
            places = self._places(words[begin : begin + 16_384])
            known, rows = places[places >= 0], -1 - places[places < 0]
            total += self.model.words.logs.total(known) + self.table[rows].sum(0, dtype=np.float64)
            weight += len(known) + int(np.count_nonzero(rows))
        if weight:
            total *= min(1.0, WORDS_COUNTED / weight)
        p = np.exp(total - total.max())
        p /= p.sum()
        best = int(p.argmax())
        return languages[best], float(p[best])


def fit(rows: DataFrame, documents: int = FIT_DOCUMENTS, languages: int = LANGUAGES) -> Backoff:
    """Fit on labelled ``text, lang, doc_id`` rows; null texts and languages are left out.

    The sample is bounded: of each of the ``languages`` most frequent languages about ``documents`` rows,
    chosen by a hash of the id, with all of their words. Words and n-grams are counted on Spark; their hashes
    and counts, a few bytes each, are all that reaches the driver.
    """
    labelled = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    by_size = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages)
    sizes = {r["lang"]: r["n"] for r in by_size.collect()}
    if not sizes:
        return Backoff({})
    names = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, documents / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = labelled.filter(draw < F.try_element_at(share, F.col("lang")))
    place = F.try_element_at(F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)]), F.col("lang"))
    words = sample.select(place.alias("k"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("k", "word").agg(F.count(F.lit(1)).alias("n"))
    marked = F.concat(F.lit("^"), "word", F.lit("$"))

    def grams(size: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.length(marked) - size + 1), lambda i: F.struct(F.lit(size).alias("size"), F.substring(marked, i, F.lit(size)).alias("text")))
        runs = F.filter(runs, lambda g: ~g["text"].isin("^", "$")) if size == 1 else runs
        return F.when(F.length(marked) >= size, runs).otherwise(F.array().cast("array<struct<size: int, text: string>>"))

    every = F.concat(F.array(F.struct(F.lit(0).alias("size"), F.col("word").alias("text"))), *[grams(size) for size in range(1, LONGEST + 1)])
    entries = words.select("k", "n", F.explode(every).alias("e")).groupBy(F.col("e.size").alias("size"), F.xxhash64("e.text").alias("name"), "k").agg(F.sum("n").alias("n"))
    size, name, k, n = (c.to_numpy() for c in entries.toArrow().columns)
    return Backoff.of(names, [(name[size == s].view(np.uint64), k[size == s].astype(np.int64), n[size == s].astype(np.float64)) for s in range(LONGEST + 1)])


def held_out() -> Column:
    """Documents that the registered query neither learns from nor counts: those of remainder 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, documents: int = FIT_DOCUMENTS) -> DataFrame:
    """Language of every text of ``doc_id, text, lang, ...``, learned from the rows that are not held out.

    Returns ``doc_id, held_out, lang_pred, score``. Null texts and texts without letters (of Unicode's
    letter categories) are ``und`` with score 0.0, and so is everything if nothing is labelled. Words of
    which not even a letter is known say nothing; without any evidence the languages are equally likely
    and the first by name is returned. A null doc_id is a document like any other. Equal texts get equal
    results, whatever their length or neighbours; other columns are not read; an empty table gives no rows.
    """
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"), documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            found = judge.predictions(batch.column(2).to_pylist())
            columns = [*batch.columns[:2], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, accepted: float = ACCEPTED) -> DataFrame:
    """The documents whose language is determined with a score of at least ``accepted``, columns as they are."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1_000):
                part = batch.slice(begin, 1_000)
                found = judge.predictions(part.column(at).to_pylist())
                yield part.filter(pa.array([lang != UNDETERMINED and score >= accepted for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))

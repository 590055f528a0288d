"""Toxicity by weak supervision: a label model over lexicon and pattern voters, then a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, load

#: The bounded sample and models: labelled rows, about; patterns among them that become features; and voters
#: among those.
FIT_ROWS, PATTERNS, VOTERS = 6_000, 1_500, 400
#: A pattern is a word, or a beginning of words of one of these lengths.
BEGINNINGS = (4, 5, 6, 7)
#: A pattern must stand in so many toxic rows of the sample.
SUPPORT = 3
THRESHOLD = 0.3
#: A pattern votes if its share of toxic rows is so many deviations above the others', which next to none of
#: a hundred thousand patterns would be by chance; features need only the smaller number.
VOTES, FEATURES = 4.5, 2.0
#: Share of given labels taken to be right before the votes are seen, as if seen in so many rows.
TRUST, TRUST_ROWS = 0.95, 2
#: This share of the toxic rows, those that the voters alone hold for toxic most surely, tells how often the
#: given label is right.
SURE = 0.25
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def patterns_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def _logit(x: np.ndarray | float) -> np.ndarray:
    return np.log(x / (1 - x))


def _share(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class LabelModel:
    """Share of toxic rows, and for each voter its accuracy and its weight beside voters correlated with it."""

    prior: float
    accuracy: np.ndarray  # share of toxic rows among those for which it votes
    weights: np.ndarray
    trust: float  # how often the given label, a voter too, is right

    def odds(self, votes: np.ndarray) -> np.ndarray:
        return _logit(self.prior) + votes @ (self.weights * (_logit(self.accuracy) - _logit(self.prior)))

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Probability of a toxic row from its votes and its given label (0 or 1)."""
        return _share(self.odds(votes) + (2 * given - 1) * _logit(self.trust))


def shared_votes(votes: np.ndarray, p: np.ndarray, least: float = 0.1) -> np.ndarray:
    """Correlations of voters within the classes, the positive ones from ``least`` on; 1 with itself."""
    toxic, clean = votes.T @ p / max(p.sum(), 1e-9), votes.T @ (1 - p) / max((1 - p).sum(), 1e-9)
    rest = votes - np.outer(1 - p, clean) - np.outer(p, toxic)
    spread = rest.std(0) + 1e-6
    related = np.clip((rest.T @ rest) / len(votes) / np.outer(spread, spread), 0, 1)
    related[related < least] = 0
    np.fill_diagonal(related, 1.0)
    return related


def fit_label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 12) -> LabelModel:
    """Estimates from moments over the votes for a row (1: votes, 0: abstains) and its noisy given label.

    Abstaining says nothing, as voters for one language are silent in another. The given label is taken to be
    wrong alike often in both classes, so a share s of given labels stands for (s - (1 - trust)) / (2 trust - 1)
    toxic rows; the share of toxic rows and each voter's accuracy are such moments. The trust is the share
    of given ones among the rows that the voters alone rank highest. A voter's weight is one over the sum of its positive correlations with
    all voters (1 with itself) within the classes, so a group of voters that always agree counts about as one.
    As no posterior feeds an accuracy, the given label's faults aren't learned as a voter's.
    """
    given = given.astype(float)
    p, cast, seen, trust = np.clip(given, 0.05, 0.95), votes.sum(0), votes.T @ given, TRUST
    for _ in range(rounds):
        toxic = lambda share: (share - (1 - trust)) / (2 * trust - 1)  # noqa: B023, E731
        prior = float(np.clip(toxic(given.mean()), 0.005, 0.5))
        accuracy = np.clip((cast * toxic(seen / np.maximum(cast, 1)) + 2 * prior) / (cast + 2), 0.001, 0.999)
        model = LabelModel(prior, accuracy, 1 / shared_votes(votes, p).sum(1), trust)
        most = max(1, int(len(given) * prior * SURE))
        right = given[np.argsort(-model.odds(votes), kind="stable")[:most]].mean()
        trust = float((most * np.clip(right, 0.55, 0.999) + TRUST_ROWS * TRUST) / (most + TRUST_ROWS))
        model.trust = trust
        p = model.posterior(votes, given)
    return model


def fit_linear(features: np.ndarray, target: np.ndarray, decay: float = 5e-5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by gradient steps with momentum (Adam)."""
    w, b = np.zeros(features.shape[1], np.float32), float(np.log(np.clip(target.mean(), 1e-3, 0.999) / np.clip(1 - target.mean(), 1e-3, 0.999)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(features @ w + b, -30, 30)))
        gap = (p - target).astype(np.float32) / len(target)
        slope = np.append(features.T @ gap + decay * w, gap.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return w, b


@dataclass
class Classifier:
    """Score of a text from how often each pattern stands in it."""

    patterns: dict[str, int]
    present: np.ndarray
    often: np.ndarray
    bias: float

    def score(self, text: str | None, seen: dict[str, tuple[int, ...]]) -> float:
        found: Counter = Counter()
        if len(seen) > REMEMBERED:
            seen.clear()
        for word, n in word_counts(text).items():
            if (hits := seen.get(word)) is None:
                hits = seen[word] = tuple(self.patterns[x] for x in patterns_of(word) if x in self.patterns)
            for i in hits:
                found[i] += n
        odds = self.bias + sum(float(self.present[i]) + float(self.often[i]) * float(np.log1p(n)) for i, n in found.items())
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, odds)))))


def _statistics(sample: DataFrame) -> DataFrame:
    """In how many toxic and clean rows of the sample each pattern stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column("text"), batch.column("toxic"), strict=True):
                (toxic if label.as_py() else clean).update({x for word in word_counts(text.as_py()) for x in patterns_of(word)})
            keys = list(toxic | clean)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["pattern", "toxic", "clean"])

    return sample.select("text", "toxic").mapInArrow(run, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(sample: DataFrame, sizes: dict[int, int], patterns: int = PATTERNS) -> list[tuple[str, float]]:
    """The ``patterns`` patterns that tell toxic rows best, with the deviations of their share, falling; ties by pattern."""
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(sizes[0] + sizes[1]))
    z = (F.col("toxic") / sizes[1] - F.col("clean") / sizes[0]) / F.sqrt(share * (1.0001 - share) * (1 / sizes[1] + 1 / sizes[0]))
    told = _statistics(sample).filter(F.col("toxic") >= SUPPORT).withColumn("z", z).filter(F.col("z") > FEATURES)
    return [(r["pattern"], r["z"]) for r in told.orderBy(F.col("z").desc(), "pattern").limit(patterns).collect()]


def fit(labelled: DataFrame, rows: int = FIT_ROWS, patterns: int = PATTERNS, voters: int = VOTERS) -> Classifier | None:
    """Fit on ``doc_id, text, toxic`` rows with a label; None without any of either class.

    About ``rows`` of them are used, chosen by a hash of the id; what reaches the driver is the best
    ``patterns`` patterns and each sampled row's counts of those, the same size for any input.
    """
    total = labelled.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = cut(labelled.filter(draw < rows / max(total, 1)).select("doc_id", "text", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    chosen = choose(sample, sizes, patterns)
    best, voters = [x for x, _ in chosen], min(voters, sum(z > VOTES for _, z in chosen))
    known = {x: i for i, x in enumerate(best)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, times = [], []
            for text in batch.column("text"):
                found: Counter = Counter()
                for word, n in word_counts(text.as_py()).items():
                    for x in patterns_of(word):
                        if x in known:
                            found[known[x]] += n
                places.append(list(found))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(places, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["toxic", "places", "times"])

    counted = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, places array<int>, times array<int>").collect()
    counts = np.zeros((len(counted), len(known)), np.float32)
    for k, r in enumerate(counted):
        counts[k, r["places"]] = r["times"]
    labels = np.array([r["toxic"] for r in counted], float)
    # the voters: each pattern standing in a text at all, each standing there again, and none of them standing there
    there = counts[:, :voters] >= 1
    ballots = np.concatenate([there, counts[:, :voters] >= 2, ~there.any(1, keepdims=True)], 1).astype(np.float32)
    ballots = ballots[:, ballots.any(0)]
    target = fit_label_model(ballots, labels).posterior(ballots, labels)
    weights, bias = fit_linear(np.concatenate([(counts > 0).astype(np.float32), np.log1p(counts)], 1), target)
    return Classifier(known, weights[: len(known)], weights[len(known) :], bias)


def held_out() -> F.Column:
    """Documents whose labels the registered query never learns from: those of remainder 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def detect(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, patterns: int = PATTERNS, voters: int = VOTERS) -> DataFrame:
    """Toxicity of every whole text of ``doc_id, text``, from ``doc_id, toxic`` labels that are not held out.

    Returns ``doc_id, held_out, score, predicted``. Null and empty texts get the score of a text without
    any pattern; without labels of both classes every score is 0.0. A text of any length is scored whole, and
    a row without an id as any other, but learned from by none. Null labels count for nothing; of
    repeated labels of a document the highest counts. Equal texts get equal scores. Other columns are not
    read; an empty table gives no rows.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("labelled")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    few = cut(known.filter(draw < 1.3 * rows / max(total, 1)))  # so few that they can be sent everywhere
    model = fit(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), rows, patterns, voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            scores = [model.score(t.as_py(), seen) if model else 0.0 for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows_in = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))

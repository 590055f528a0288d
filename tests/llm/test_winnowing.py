import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spoorless.llm import winnowing as w


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9), st.integers(1, 7))
def test_winnow_against_brute_force(codes, k, size):
    codes = np.array(codes, np.uint32)
    hashes = w.gram_hashes(codes, k)
    grams = [tuple(codes[i : i + k]) for i in range(max(1, len(codes) - k + 1))] if len(codes) else []
    assert len(hashes) == len(grams)
    assert len({int(h) for h in hashes}) == len(set(grams))
    high = [int(h) >> 32 for h in hashes]
    chosen = {}
    for i in range(max(1, len(high) - size + 1) if high else 0):
        window = high[i : i + size]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        chosen[at] = high[at]
    got = w.winnow(hashes, size)
    assert list(zip(got[1].tolist(), got[0].tolist())) == sorted(chosen.items())


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        sets = [set(w.fingerprint(t)[0].tolist()) for t in (text, edited, after)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        yield i, len(text), hashlib.sha256(edited.encode()).hexdigest(), w.digest(w.fingerprint(text)), w.digest(w.fingerprint(edited)), like(sets[0], sets[1]), like(sets[0], sets[2])


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc dé🙂"), n)) for n in rng.integers(0, 400, 57)]
    rows = [(7 * i - 30, t) for i, t in enumerate([*texts, None, "", "x", texts[0]])]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, part string")
    for parts in (1, 2, 9):
        got = sorted(map(tuple, w.compare_with_next(docs, parts=parts).collect()))
        assert got == sorted(brute(rows))


def test_single_null_and_repeated_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    (one,) = w.compare_with_next(spark.createDataFrame([(5, "abc" * 30)], schema)).collect()
    assert one["near_edited"] > 0 and one["near_next"] == 1.0
    assert w.compare_with_next(spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, "b")], schema), parts=3).count() == 4
    assert w.compare_with_next(spark.createDataFrame([], schema)).count() == 0


def test_shared_passage_shares_a_hash(spark):
    passage = "a passage of exactly the guaranteed length here."[: w.GRAM + w.WINDOW - 1]
    docs = spark.createDataFrame([(1, "one beginning, " + passage), (2, passage + " another end of it")], "doc_id long, text string")
    a, b = w.fingerprints(docs).collect()
    assert set(a["hashes"]) & set(b["hashes"])

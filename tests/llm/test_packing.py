import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from spoorless.llm import packing

ODD = ["", None, "Don't  stop.\tNow,\n42 times... e.g. <|endoftext|> x<|startoftext|>y", "Ünïcöde É́ KK  nb İstanbul ŉ 1½²", "́ abc ̸= x",
       "漢字かな交じり文、テスト。 한국어", "a\x1cb\x1fc \x85d e", "we'll we've it's, I'm. they'd 'tis ''s", "!!!... ,,, ., a., b,.", "zs̀́ 힣 🙂👨‍👩‍👧 ok", "x" * 5000, "word " * 3000]


def ids_of(text):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(spark, texts, capacity=2048):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sequence_id string")
    rows = packing.pack(docs, capacity=capacity, rounds=40).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.asarray(ids_of(text), "<u4")
        for k, r in enumerate(by_doc[i]):
            part = ids[k * capacity : (k + 1) * capacity]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, k * capacity, len(part), zlib.crc32(part.tobytes()))
        assert len(by_doc[i]) == -(-len(ids) // capacity)
    full = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == full.get(r["sequence_id"], 0)
        full[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(full.values()) <= capacity
    return full


def test_whole_texts_are_tokenized_exactly_and_packed_gapless(spark):
    check(spark, ODD)


def test_repeated_documents_and_few_sequences(spark):
    full = check(spark, ["one two three four five six"] * 300 + ["seven " * 40] * 20, capacity=64)
    assert len(full) <= 1.05 * sum(full.values()) / 64 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_holds_exactly_the_histogram_near_the_volume_bound():
    rng = np.random.default_rng(1)
    histogram = Counter(int(x) for x in np.minimum(2048, rng.lognormal(5.5, 1.2, 60_000) + 1))
    plan = packing.plan_sequences(dict(histogram))
    held = Counter()
    for config, times in plan:
        assert sum(length * n for length, n in config) <= 2048
        for length, n in config:
            held[length] += n * times
    assert held == histogram
    volume = sum(k * n for k, n in histogram.items()) / 2048
    assert sum(times for _, times in plan) <= 1.01 * volume + 1


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 12, 4))
        prices = rng.random(len(lengths))
        best = 0.0
        ranges = [range(17 // int(k) + 1) for k in lengths]
        for counts in np.array(np.meshgrid(*ranges)).reshape(len(lengths), -1).T:
            if counts @ lengths <= 17:
                best = max(best, float(counts @ prices))
        got = packing._priciest(lengths, prices, 17)
        assert got @ lengths <= 17 and abs(got @ prices - best) < 1e-9

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spoorless.llm import attention, scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(t for (_, text), out in zip(rows, held, strict=True) if not out for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    base = lambda ts: sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
    return [(i, out, len(ts := tokens(text)), sum(counts[t] > 0 for t in ts), n, base(ts)) for (i, text), out in zip(rows, held, strict=True)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, BLOCK int, keys string")


@pytest.mark.parametrize("chars", [4_000_000, 60])
def test_base_against_brute_force_and_shape_of_the_score(spark, chars):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(["Alpha", "beta", "GAMMA", "Élan", "δ", "x\x1cy", "a b"], 12)) + "\n\t\x0b") for k in range(60)]
    rows += [(100, ""), (101, None), (102, " \n"), (None, "no id"), (7, "again"), (7, "again"), (8, "long " * 3000), (9, "İ K ſ")]
    found = scoring.scored(table(spark, rows).repartition(3), share=1.0, shard=200, chars=chars).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for got, want in zip(sorted(found, key=key), sorted(brute(rows), key=key), strict=True):
        assert tuple(got)[:5] == want[:5] and got["base_score"] == pytest.approx(want[5], rel=1e-9)
        assert got["score"] < 0
    again = {r["doc_id"]: r["score"] for r in found if r["doc_id"] == 7}
    assert len(again) == 1
    assert len({round(r["score"], 3) for r in found if r["doc_id"] in (100, 101, 102)}) == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(3, "x")]])
def test_few_rows(spark, rows):
    found = scoring.scored(table(spark, rows)).collect()
    assert [tuple(r)[:5] for r in found] == [w[:5] for w in brute(rows)]
    assert all(r["base_score"] == pytest.approx(w[5]) for r, w in zip(found, brute(rows), strict=True))


def tiny(monkeypatch, counts):
    monkeypatch.setattr(attention, "WIDTH", 8)
    outputs = attention.Outputs(counts, 16, 4)
    p = attention.initial(outputs)
    p["class"], p["member"] = p["class"] * 30, p["member"] * 30
    return outputs, {k: v.astype(np.float64) for k, v in p.items()}


def test_gradients_against_differences(monkeypatch):
    _, p = tiny(monkeypatch, np.arange(20))
    rng = np.random.default_rng(2)
    inputs, targets = rng.integers(0, 17, (3, attention.WINDOW)), rng.integers(0, 16, (3, attention.WINDOW))
    scored = rng.random(inputs.shape) < 0.7
    _, g = attention.gradients(p, inputs, targets, scored)
    for name, value in p.items():
        for at in rng.integers(0, value.size, 4):
            at, step, old = np.unravel_index(at, value.shape), 1e-5, value[np.unravel_index(at, value.shape)]
            value[at] = old + step
            up, _ = attention.gradients(p, inputs, targets, scored)
            value[at] = old - step
            down, _ = attention.gradients(p, inputs, targets, scored)
            value[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2 / step, abs=2e-6), name


def test_scores_against_one_token_after_the_other(monkeypatch):
    """Each token once, seeing its window up to itself; and the probabilities of all ids add up to one."""
    outputs, p = tiny(monkeypatch, np.arange(40) % 7)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, n) for n in (1, 2, 31, 32, 33, 56, 57, 150)]
    got = attention.scores(p, outputs, np.concatenate(texts), np.array([len(t) for t in texts]))

    def one(context, ids):
        x = p["embed"][context]
        q, k, v = np.split(x @ p["qkv"][0], 3, axis=1)
        w = np.exp(q[-1] @ k.T + p["near"][0][attention.WINDOW - len(context) :])
        state = x[-1] + (w / w.sum()) @ v @ p["mix"][0]
        state = state + np.maximum(state @ p["up"] + p["up0"], 0) @ p["down"]
        soft = lambda z: z - np.log(np.exp(z).sum())
        top = soft(state @ p["class"] + p["class0"])
        all_ = np.concatenate([top[c] + soft(state @ p["member"][c] + p["member0"][c]) for c in range(len(top))])
        return all_[outputs.place[ids]] + outputs.within[ids]

    for ids, total in zip(texts, got, strict=True):
        want = 0.0
        line = np.concatenate([[outputs.count], outputs.place[ids[:-1]]])
        for t in range(len(ids)):
            begin = 0 if t < attention.WINDOW else (t - attention.CONTEXT) // (attention.WINDOW - attention.CONTEXT) * (attention.WINDOW - attention.CONTEXT)
            want += one(line[begin : t + 1], ids[t : t + 1])[0]
        assert total == pytest.approx(want, rel=1e-5)
    every = one(line[:5], np.arange(40))
    assert np.exp(every).sum() == pytest.approx(1.0)


def test_learns_what_follows_what(spark):
    """Held-out texts of a grammar score better by the model than by word counts, and shuffled ones worse."""
    rng = np.random.default_rng(4)
    nouns = ["cat", "dog", "bird", "fish"]
    def sentence():
        k = rng.integers(4)
        return f"the {nouns[k]} likes the {nouns[(k + 1) % 4]} and then"
    rows = [(k, " ".join(sentence() for _ in range(8))) for k in range(1500)]
    found = scoring.scored(table(spark, rows), share=1.0, shard=1_000).filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert found["sum(score)"] > 0.6 * found["sum(base_score)"]


def test_every_token_of_training_texts_is_a_target_once(spark):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(rng.choice(["alpha", "Beta", "unübersehbar", "x1y2z3"], rng.integers(0, 90)))) for k in range(80)] + [(100, None), (None, "no id")]
    path = scoring.default_tokenizer()
    told = scoring.told_blocks(table(spark, rows).repartition(3), path, chars=2_000).persist()
    encoder = scoring.Words(path)
    model = scoring.Model(scoring.id_counts(told, encoder.end + 1))
    want = Counter()
    for i, text in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            want.update(model.outputs.place[encoder.encode(scoring.words(text))[0]].tolist())
    got, blocks, n = Counter(), told.filter("what = 'block'").collect(), 0
    for row in blocks:
        for turn in range(scoring.ROUNDS):
            _, targets, scored = model.lessons(row["ids"], row["lengths"], turn, scoring.ROUNDS)
            got.update(targets[scored].tolist())
            n += len(targets)
    assert got == want and n == sum(r["n_windows"] for r in blocks) and len(blocks) > 3


def test_learns_from_all_texts_unless_told_otherwise(spark):
    rows = [(k, "one two three four five six seven " * 6) for k in range(3000)]
    found = scoring.scored(table(spark, rows), shard=1_000).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert found["sum(score)"] > 0.6 * found["sum(base_score)"]
    with pytest.raises(ValueError):
        scoring.scored(table(spark, rows), share=0.5)

import random

import numpy as np
import pytest

from spoorless.llm import ngram_join as nj


def sets(text):
    words = nj._WORD.findall((text or "").lower())
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    able = [bool(x) and i is not None for (i, _), x in zip(rows, s)]
    link = [[j for j in range(len(rows)) if j != k and able[k] and able[j] and len(s[k] & s[j]) >= 0.8 * len(s[k] | s[j])] for k in range(len(rows))]
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        copies = [rows[j][0] for j in range(len(rows)) if able[j] and able[k] and s[j] == s[k]]
        out.append((i, min((rows[j][0] for j in seen), key=lambda x: (x is None, x)), min(copies) if copies else i, len(link[k])))
    return sorted(out, key=str)


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(30, 200))] for _ in range(20)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            b[rng.randrange(len(b))] = word()
        if rng.random() < 0.3:
            b += passage
        rows.append((i, " ".join(b)))
    return [*rows, (900, None), (901, ""), (902, "one two"), (903, "One, two!"), (904, "..."), (None, rows[0][1]), (5, rows[5][1])]


@pytest.mark.parametrize("limit,piece", [(512, 512), (8, 9)])
def test_against_brute_force(spark, monkeypatch, limit, piece):
    monkeypatch.setattr(nj, "PIECE", piece)
    monkeypatch.setattr(nj.chosen_paths, "__defaults__", (limit, nj.DEPTH))
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, bucket string")
    got, want = sorted(map(tuple, nj.jaccard_join(docs).collect()), key=str), brute(rows)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert len(got) == len(want) and len(wrong) <= 0.03 * len(want), wrong[:5]
    assert sum(w[3] for w in want) * 0.99 <= sum(g[3] for g in got) <= sum(w[3] for w in want)
    kept = {r["doc_id"] for r in nj.keep_one_each(docs).collect()}
    assert kept == {g[0] for g in got if g[0] == g[1]}


def test_empty_table_and_recall():
    assert nj.runs_for() >= 4
    rng = np.random.default_rng(1)
    shingler = nj.Shingler()
    a = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    b = np.concatenate([a[:900], np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))])
    agree = np.mean(shingler.signature(a) == shingler.signature(b))
    assert abs(agree - 900 / 1100) < 0.2


def test_empty_table(spark):
    assert nj.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0

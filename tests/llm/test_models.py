import math
import random
import re
import zlib

import numpy as np
import pytest

from spoorless.llm import language, toxicity

rng = random.Random(11)
SYLLABLES = {"aa": ["ka", "lo", "mi", "ta", "ru"], "bb": ["xe", "zu", "qi", "vo", "ny"], "cc": ["ßä", "öl", "ün", "chs", "ft"]}


def prose(lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def test_language_on_held_out_rows(spark):
    rows = [(i, prose(lang, rng.randint(3, 60)), lang) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 %% 34", "bb"), (1003, rows[0][1], None), (1004, "漢字", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language.identify(docs, 80).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"]]) > 0.97
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003]["lang_pred"] == got[0]["lang_pred"] and got[1004]["lang_pred"] in SYLLABLES and all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in language.keep_identified(docs).collect()}
    assert kept >= {i for i, _, _ in rows} and not kept & {1000, 1001, 1002}


def test_backoff_order():
    model = language.Backoff({"aa": {"kalo": 5, "mita": 2}, "bb": {"xezu": 5, "kal": 1}})
    assert (model.evidence("kalo") == model.words.logs[model.words.rows["kalo"]]).all()
    assert model.evidence("kalolo").argmax() == 0 and model.evidence("xezuzu").argmax() == 1
    assert model.evidence("漢") is None
    assert language.Judge(language.Backoff({})).predict("abc") == ("und", 0.0)
    one = language.Judge(language.Backoff({"en": {"word": 1}}))
    assert [one.predict(t) for t in ("½ ² ① Ⅷ", "_ 12", None, "")] == [("und", 0.0)] * 4 and one.predict("ǆ")[0] == "en"


def test_language_scores_against_brute_force():
    counts = {lang: {} for lang in SYLLABLES}
    for lang in counts:
        for word in prose(lang, 400).split():
            counts[lang][word] = counts[lang].get(word, 0) + 1
    names = sorted(counts)

    def grams(word, n):
        w = f"^{word}$"
        return [w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] not in ("^", "$")]

    def frequencies(of):
        table = {}
        for k, lang in enumerate(names):
            for word, n in counts[lang].items():
                for x in of(word):
                    table.setdefault(x, [0.0] * len(names))[k] += n
        total = [sum(v[k] for v in table.values()) for k in range(len(names))]
        return {x: [math.log((v[k] + 0.1) / (total[k] + 0.1 * len(table))) for k in range(len(names))] for x, v in table.items()}

    tables = [frequencies(lambda w: [w]), *(frequencies(lambda w, n=n: grams(w, n)) for n in range(1, 6))]

    def brute(text):
        rows = []
        for word in text.lower().split():
            if word in tables[0]:
                rows.append(tables[0][word])
                continue
            for n in (5, 4, 3, 2, 1):
                found = [tables[n][g] for g in grams(word, n) if g in tables[n]]
                if found:
                    centred = [[x - sum(r) / len(r) for x in r] for r in found]
                    rows.append([sum(r[k] for r in centred) / len(centred) for k in range(len(names))])
                    break
        rows = [[x - sum(r) / len(r) for x in r] for r in rows]
        scale = min(1.0, 24 / len(rows)) if rows else 0
        sums = [scale * sum(r[k] for r in rows) for k in range(len(names))]
        p = [math.exp(x - max(sums)) for x in sums]
        return names[p.index(max(p))], max(p) / sum(p)

    judge = language.Judge(language.Backoff(counts), remembered=50)
    for text in [*(prose(lang, n) for lang in names for n in (1, 2, 5, 40, 3000)), "漢字", "kalo xezu chsft", "kx"]:
        got, want = judge.predict(text), brute(text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-4, text


def test_language_of_null_ids_long_texts_and_columns_of_like_names(spark):
    long_text = prose("bb", 150_000)
    rows = [(i, prose(lang, 30), lang, "x") for i, lang in enumerate(list(SYLLABLES) * 10)] + [(None, prose("aa", 20), None, "y"), (None, None, "aa", "z"), (99, long_text, None, "w")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, _text string, score int")
    kept = sorted(map(tuple, language.keep_identified(docs).collect()), key=str)
    assert kept == sorted([(*r, 1) for r in rows if r[1]], key=str)
    got = {(r["doc_id"], r["score"] > 0): r["lang_pred"] for r in language.identify(docs).collect()}
    assert got[None, True] == "aa" and got[None, False] == "und" and got[99, True] == "bb"


def test_language_of_empty_table(spark):
    assert language.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    bad = ["vilecur", "rotgut", "slimeball"]
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose("aa", 40).split(), i % 5 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(words)))
        labels += [(i, int(toxic))] * (1 if i % 4 else 2)
    rows += [(900, None), (901, ""), (902, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(docs, spark.createDataFrame([*labels, (900, None), (None, 1)], "doc_id long, toxic int")).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values() if r["doc_id"] < 600) == len(held)
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and got[900]["score"] == got[901]["score"] and got[902]["score"] == got[0]["score"]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.detect(docs, none).collect()] == [(0.0, 0)]
    assert toxicity.detect(docs.limit(0), none).count() == 0


def test_label_model_against_enumeration():
    gen = np.random.default_rng(3)
    # every combination of four voters, as often as it is to be expected: three toxic ones and a calm one, apart given the class
    prior, fires = 0.3, np.array([[0.5, 0.02], [0.4, 0.03], [0.3, 0.01], [0.1, 0.6]])
    combos = np.array(np.meshgrid(*[[0, 1]] * 4)).reshape(4, -1).T
    like = lambda v, y: np.prod([f[1 - y] if x else 1 - f[1 - y] for x, f in zip(v, fires)])
    times = [(round(40_000 * prior * like(v, 1)), round(40_000 * (1 - prior) * like(v, 0))) for v in combos]
    votes = np.concatenate([np.repeat(v[None, :], n, 0) for v, pair in zip(combos, times) for n in pair]).astype(np.float32)
    truth = np.concatenate([np.full(n, 1 - k) for pair in times for k, n in enumerate(pair)])
    given = np.where(gen.random(len(truth)) < 0.1, 1 - truth, truth)  # a tenth of the given labels is wrong
    model = toxicity.fit_label_model(votes, given)
    assert (model.accuracy[:3] > 0.8).all() and model.accuracy[3] < model.prior and (model.weights > 0.5).all() and 0.85 < model.trust < 0.97
    for row in np.unique(np.concatenate([votes, given[:, None]], 1), axis=0):  # Bayes' rule over both classes
        weigh = [model.prior * (model.trust if row[4] else 1 - model.trust), (1 - model.prior) * (1 - model.trust if row[4] else model.trust)]
        for x, a, w in zip(row, model.accuracy, model.weights):
            if x:
                weigh = [weigh[0] * (a / model.prior) ** w, weigh[1] * ((1 - a) / (1 - model.prior)) ** w]
        assert abs(model.posterior(row[None, :4], row[4])[0] - weigh[0] / sum(weigh)) < 1e-5
    judged = model.posterior(votes, given) > 0.5
    assert (judged == (truth == 1)).mean() > (given == truth).mean() and (judged != (given == 1)).any()  # it mends given labels
    doubled = toxicity.fit_label_model(np.concatenate([votes, votes[:, :1], votes[:, :1]], 1), given)
    assert doubled.weights[0] < 0.6 * model.weights[0]  # three voters that always agree


@pytest.mark.parametrize("noise", [0.0, 0.15])
def test_label_model_mends_turned_labels(noise):
    gen = np.random.default_rng(8)
    truth = gen.random(6000) < 0.12
    fires = np.concatenate([gen.uniform(0.3, 0.6, 12), gen.uniform(0.05, 0.15, 40)])  # strong and weak voters
    votes = (gen.random((6000, 52)) < np.where(truth[:, None], fires, fires / 60)).astype(np.float32)
    votes = np.concatenate([votes, ~votes.any(1, keepdims=True)], 1).astype(np.float32)
    given = np.where(gen.random(6000) < noise, ~truth, truth).astype(float)
    model = toxicity.fit_label_model(votes, given)
    p = model.posterior(votes, given)
    # the trust is a share of some 180 rows, so a deviation is 0.027 with noise, and the share of toxic rows follows it
    assert abs(model.trust - (1 - noise)) < (0.06 if noise else 0.01) and abs(model.prior - truth.mean()) < (0.06 if noise else 0.01)
    assert ((p > 0.5) == truth).mean() > (0.94 if noise else 0.99) and (given == truth).mean() == pytest.approx(1 - noise, abs=0.02)
    for j in range(12):  # the share of toxic rows among those for which it votes
        assert abs(model.accuracy[j] - truth[votes[:, j] == 1].mean()) < 0.12


def test_voters_against_brute_force(spark):
    rows = [(prose("aa", 8) + (" Vilecur rotgut" if i % 3 == 0 else ""), int(i % 3 == 0 or i % 11 == 0)) for i in range(200)] + [(None, 0), ("", 1)]
    sizes = {k: sum(y == k for _, y in rows) for k in (0, 1)}
    stands = {}
    for text, y in rows:
        for x in {x for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for x in [w] + [w[:k] + "*" for k in (4, 5, 6, 7) if len(w) > k]}:
            stands.setdefault(x, [0, 0])[y] += 1
    want = {}
    for x, (clean, toxic) in stands.items():
        share = (clean + toxic) / len(rows)
        z = (toxic / sizes[1] - clean / sizes[0]) / np.sqrt(share * (1.0001 - share) * (1 / sizes[1] + 1 / sizes[0]))
        if toxic >= toxicity.SUPPORT and z > toxicity.FEATURES:
            want[x] = z
    got = toxicity.choose(spark.createDataFrame(rows, "text string, toxic int"), sizes)
    assert dict(got) == pytest.approx(want) and [z for _, z in got] == sorted(want.values(), reverse=True) and "rotgut" in want
    assert len(toxicity.choose(spark.createDataFrame(rows, "text string, toxic int"), sizes, 3)) == 3


def test_the_classifier_is_the_regressions_optimum():
    gen = np.random.default_rng(4)
    features = (gen.random((500, 6)) < 0.4).astype(np.float32)
    target = 1 / (1 + np.exp(-(features @ np.array([2, -1, 0, 1, 0, -2]) - 0.5)))
    w, b = toxicity.fit_linear(features, target, decay=1e-2, rounds=2000)
    x, want = np.c_[features, np.ones(500)].astype(float), np.zeros(7)
    for _ in range(50):  # Newton's method on the same loss
        p = 1 / (1 + np.exp(-x @ want))
        slope = x.T @ (p - target) / 500 + 1e-2 * np.r_[want[:6], 0]
        want -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / 500 + 1e-2 * np.diag([1] * 6 + [0]), slope)
    assert np.allclose(np.append(w, b), want, atol=0.02)


def test_toxicity_of_null_ids_and_long_texts(spark):
    rows = [(i, prose("aa", 20) + (" vilecur rotgut" if i % 4 == 0 else "")) for i in range(120)] + [(None, "vilecur rotgut"), (None, None), (500, "vilecur rotgut " + prose("aa", 100_000))]
    labels = [(i, int(i % 4 == 0)) for i in range(120)]
    got = toxicity.detect(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 2 and all(0 <= r["score"] <= 1 for r in got)


def test_the_engine_and_the_model_know_words_by_the_same_hash(spark):
    words = ["", "a", "naïve", "漢字", "🙂x", "long" * 50]
    got = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w) AS h").collect()
    assert [r["h"] % (1 << 64) for r in got] == [language.name_of(w) for w in words]


def test_the_fit_counts_as_the_model_does(spark):
    rows = [(i, prose(lang, 30) + " x Éa", lang) for i in range(12) for lang in SYLLABLES]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: {} for lang in SYLLABLES}
    for _, text, lang in rows:
        for word in text.lower().split():
            counts[lang][word] = counts[lang].get(word, 0) + 1
    want = language.Backoff(counts)
    for a, b in zip([model.words, *model.grams], [want.words, *want.grams], strict=True):
        assert (a.rows.names == b.rows.names).all() and np.allclose(a.logs.more, b.logs.more) and np.allclose(a.logs.base, b.logs.base)


def test_two_hundred_languages_of_twenty_thousand_words_fit_into_a_gigabyte():
    import tracemalloc

    draw = np.random.default_rng(9)
    tracemalloc.start()
    triples = []
    for entries in (20_000, 40, 700, 6_000, 15_000, 25_000):
        names = draw.integers(0, 1 << 63, 200 * entries, np.uint64) if entries > 1_000 else draw.integers(0, 2_000, 200 * entries).astype(np.uint64)
        triples.append((names, np.repeat(np.arange(200), entries), np.ones(200 * entries)))
    model = language.Backoff.of([f"l{k:03}" for k in range(200)], triples)
    judge = language.Judge(model)
    assert judge.predict("some words that nobody knows")[0] in model.languages
    assert tracemalloc.get_traced_memory()[1] < 1_000_000_000
    tracemalloc.stop()

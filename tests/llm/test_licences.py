import random
import time
from collections import Counter

from spoorless.llm import licences as lc


TEMPLATES = [(licence, lc.bigrams(lc.normal_words(text))) for licence, text in lc.standard_templates()]


OWNERS = {}
for _licence, _grams in TEMPLATES:
    for _gram in _grams:
        OWNERS.setdefault(_gram, set()).add(_licence)


def brute(text, threshold=lc.DICE):
    """The best coefficient of every window of words, wherever it begins and ends, against every template.

    A window must hold a bigram that only this licence has, if there is one.
    """
    words = lc.normal_words(text or "")
    every, best = list(zip(words, words[1:])), 0.0
    for _, grams in TEMPLATES:
        if grams.keys().isdisjoint(every):
            continue
        own = {g for g in grams if len(OWNERS[g]) == 1} or set(grams)
        for i in range(len(every)):
            have, shared = Counter(), 0
            for j in range(i, len(every)):
                have[every[j]] += 1
                shared += have[every[j]] <= grams[every[j]]
                if not own.isdisjoint(have):
                    best = max(best, 2 * shared / (j - i + 1 + grams.total()))
    return best if best >= threshold else 0.0


TEXTS = [
    None, "", "plain prose.\nand more of it.",
    "Some words.\nLicensed under the Apache License, Version 2.0.\nmore",
    "Released under the MIT Licence.", "This work is licensed under CC BY-NC 4.0", "We discuss the MIT License at length in this line of prose.",
    "intro\n" + lc.TEXTS["MIT"][0].replace(", ", ",\n") + "\nend", lc.TEXTS["Apache-2.0"][0][:300],
    "Licensed under\nthe BSD 3-Clause License\n\nReleased under the MIT License.", "licensed under the licensed under the licensed", "x " * 300 + "\nReleased under the Unlicense.", None, "One line: " + lc.TEXTS["ISC"][1].replace("fee", "any fee", 1) + " and prose after it.",
    "It is Licensed under the Apache License, Version 2.0, as is the rest.", "/* SPDX-License-Identifier: BSD-3-Clause */ int x;", "SPDX-License-Identifier: Other", "It is licensed under the terms of the Foo License.", "Licensed under the Foo.",
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, licence string")
    rows = {r["doc_id"]: r for r in lc.scan(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert abs(rows[i]["dice"] - brute(text)) < 1e-12, i
        assert (rows[i]["licence"] is None) == (rows[i]["n_notices"] == 0)
    assert rows[3]["licence"] == "Apache-2.0" and rows[4]["licence"] == "MIT" and rows[5]["licence"] == "CC-BY-NC-4.0"
    assert [(n["first_line"], n["n_lines"], n["licence"]) for n in rows[9]["notices"]] == [(0, 2, "BSD-3-Clause"), (3, 1, "MIT")]
    assert rows[13]["licence"] == "ISC" and [(n["first_word"], n["n_lines"]) for n in rows[13]["notices"]] == [(2, 1)]
    assert rows[14]["licence"] == "Apache-2.0" and rows[15]["licence"] == "BSD-3-Clause" and [rows[i]["licence"] for i in (16, 17, 18)] == [None] * 3
    assert rows[7]["licence"] == "MIT" and rows[7]["notices"][0]["n_lines"] > 5


def test_every_template_is_found():
    for _, text in lc.standard_templates():
        scanner = lc.Scanner([("x", text)])
        assert scanner.scan("some words before\n" + text + "\nand after"), text


def test_random_windows_against_brute_force():
    rng = random.Random(5)
    scanner = lc.Scanner(lc.standard_templates())
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(lc.standard_templates())[1].split()[: rng.choice([12, 40, 60])]
            for _ in range(rng.randint(0, 1 + len(words) // 4)):
                words[rng.randrange(len(words))] = rng.choice(["x", "the", "license", words[0]])
            parts += [rng.choice(["", "some prose", "\n", "the the"]), " ".join(words)]
        text = " ".join(parts)
        found = scanner.scan(text)
        assert abs(max((x[3] for x in found), default=0.0) - brute(text)) < 1e-12, text
        for a, b in zip(found, found[1:]):
            assert a[4] + a[5] <= b[4]


def test_each_licence_is_told_by_its_own_template():
    scanner = lc.Scanner(lc.standard_templates())
    for licence, text in lc.standard_templates():
        found = scanner.scan(f"Copyright 2020 by the owners. {text} More prose follows on this line.")
        assert [x[2] for x in found if x[3] == 1.0] == [licence], (licence, found)


def test_many_notices_take_time_in_proportion():
    begin = time.perf_counter()
    found = lc.Scanner(lc.standard_templates()).scan("Released under the MIT License.\n\n" * 20_000)
    assert len(found) == 20_000 and {x[2] for x in found} == {"MIT"}
    assert time.perf_counter() - begin < 30


def test_empty_table(spark):
    assert lc.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_and_long_texts(spark):
    long = "prose of many words. " * 200_000 + "Released under the MIT License." + " and more" * 200_000
    docs = spark.createDataFrame([(None, "Released under the MIT License.", 1), (None, None, 2), (7, long, 3)], "doc_id long, text string, dice int")
    got = lc.scan(docs).collect()
    assert sorted((r["doc_id"] is None, r["licence"] or "") for r in got) == [(False, "MIT"), (True, ""), (True, "MIT")]
    assert [r["notices"][0]["first_word"] for r in got if r["doc_id"] == 7] == [800_000]

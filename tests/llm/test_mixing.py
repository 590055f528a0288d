import math

from spoorless.llm import mixing


def size(text):
    return len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w])


def brute(rows, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Reshare the excess by weight until no target is above its top."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return sizes, target


ROWS = [(i, "word " * (i % 7), ["a", "b", "c", None, "Z"][i % 5] if i % 3 else "a") for i in range(400)] + [(400, None, "b"), (401, "", "empty"), (402, "x\x0by\x85z", "c")]


def test_targets_and_copies_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, 9, "r") for r in ROWS], "doc_id long, text string, source string, size int, rate string")
    sizes, target = brute(ROWS)
    got = {r["doc_id"]: r for r in mixing.taken(docs).collect()}
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        assert (r["size"], r["rate"]) == (9, "r")
    for i, text, source in ROWS:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size(text), sizes[source]) and math.isclose(r["target"], target[source], abs_tol=1e-9)
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] == copies.get(i, 0) * r["size"])
    for s in sizes:
        taken = sum(got[i]["taken"] for i, _, source in ROWS if source == s)
        assert abs(taken - target[s]) <= 0.25 * target[s] + 30
    assert math.isclose(sum(target.values()), 1.5 * sum(sizes.values()))


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.taken(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in mixing.taken(spark.createDataFrame([(1, None, None)], schema)).collect()] == [(1, 0, 0, 0.0, 0)]


def test_columns_of_like_names_null_ids_and_long_texts(spark):
    rows = [(1, "a b", "s", 1, "p", 0.5), (None, "c " * 100_000, "s", None, "q", None), (None, None, None, 3, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, own_0 int, _one string, _rate double")
    got = mixing.mix(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)
    assert sorted((r["doc_id"] or 0, r["size"], r["source_size"]) for r in mixing.taken(docs).collect()) == [(0, 0, 0), (0, 100_000, 100_002), (1, 2, 100_002)]


def test_rows_that_share_an_id_or_have_none_draw_each_for_itself(spark):
    rows = [(None, f"{'w ' * 10}{k % 40}", "none") for k in range(500)] + [(7, f"{'w ' * 10}", "same") for _ in range(500)] + [(1_000 + k, "w " * 10, "c") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.taken(docs).groupBy("doc_id").agg({"taken": "sum", "target": "max", "size": "count"}).filter("doc_id IS NULL OR doc_id = 7").collect()
    for r in got:
        assert r["count(size)"] == 500 and abs(r["sum(taken)"] - r["max(target)"]) <= 0.12 * r["max(target)"]
    mixed = {r["source"]: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    taken = {r["source"]: r["n"] for r in mixing.taken(docs).selectExpr("CASE WHEN doc_id IS NULL THEN 'none' WHEN doc_id = 7 THEN 'same' ELSE 'c' END AS source", "taken / size AS c").groupBy("source").agg({"c": "sum"}).withColumnRenamed("sum(c)", "n").collect()}
    assert mixed == taken

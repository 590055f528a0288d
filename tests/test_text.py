import random

import duckdb
import pytest
from pyspark.sql import functions as F

from spoorless.functions import markup, scalars
from spoorless.functions import text as t
from spoorless.plans import catalogue

CASES = [
    ("a​b c", "ab c", 2), ("\U0001f468‍\U0001f469‍\U0001f467", "\U0001f468‍\U0001f469‍\U0001f467", 0), ("❤️ ✈️", "❤️ ✈️", 0),
    ("می‌خواهم", "می‌خواهم", 0), ("ab", "ab", 1), ("​‍❤", "‍❤", 1), ("a️‍x", "a‍x", 1), ("", "", 0),
]


def within(c, ranges):
    return any(a <= c <= b for a, b in ranges)


def counted(s, i):
    """One character's judgement, told without patterns."""
    c = ord(s[i])
    before, after = (ord(s[i - 1]) if i else None), (ord(s[i + 1]) if i + 1 < len(s) else None)
    if not within(c, t.INVISIBLE):
        return False
    if c in (0x200D, 0xFE0F) and before is not None:
        if within(before, t.EMOJI) or (c == 0x200D and after is not None and (within(after, t.EMOJI) or before == 0xFE0F)):
            return False
    if before is None or after is None:
        return True
    if c in (0x200C, 0x200D):
        return not any(within(before, [r]) and within(after, [r]) for r in t.JOINED_SCRIPTS)
    return not any(within(c, [m]) and (within(before, [b]) or within(after, [b])) for m, b in t.NEIGHBOURS)


def test_cases_and_random_strings(spark):
    rng = random.Random(1)
    pool = [chr(c) for r in (t.INVISIBLE, t.SPACES, t.EMOJI, t.JOINED_SCRIPTS, *t.NEIGHBOURS) for a, b in r for c in (a, b)] + list("ax ") * 4
    strings = [s for s, _, _ in CASES] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 7))) for _ in range(4000)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    rows = df.select("i", t.invisible_count(F.col("s")).alias("n"), t.space_count(F.col("s")).alias("m"), t.clean_text(F.col("s")).alias("c")).collect()
    for r in rows:
        s = strings[r["i"]]
        gone = [counted(s, k) for k in range(len(s))]
        spaces = [within(ord(c), t.SPACES) for c in s]
        assert (r["n"], r["m"]) == (sum(gone), sum(spaces)), ascii(s)
        assert r["c"] == "".join(" " if sp else c for c, g, sp in zip(s, gone, spaces) if not g)
    for r, (_, want, n) in zip(sorted(rows), CASES):
        assert r["c"] == want and r["n"] + r["m"] == n


MARKUP = [
    ('<meta name="generator" content="x"><p data-ai-model="m">t</p>', "html", 2, "<p>t</p>"),
    ("<META property='C2PA'><p DATA-llm=\"m\">", "xhtml", 2, "<p>"),
    ('<svg><metadata a="1">x\ny</metadata ><circle/></svg>', "svg", 1, "<svg><circle/></svg>"),
    ("---\ntitle: t\ngenerator: g\n---\nbody", "md", 1, "---\ntitle: t\n\n---\nbody"),
    ("---\r\nAuthor: a\r\ntitle: t\r\n---\nmodel: kept", "markdown", 1, "---\r\ntitle: t\r\n---\nmodel: kept"),
    ("generator: g", "md", 0, "generator: g"), ("---\ngenerator: g", "md", 0, "---\ngenerator: g"), ("<metadata>x</metadata>", "txt", 0, "<metadata>x</metadata>"),
    ('<p data-aisle="3">', "html", 1, "<p>"),
]


@pytest.mark.parametrize("text,ext,count,clean", MARKUP)
def test_markup(spark, text, ext, count, clean):
    df = spark.createDataFrame([(text, ext)], "t string, e string")
    r = df.select(markup.metadata_count(F.col("t"), F.col("e")).alias("n"), markup.clean_markup(F.col("t"), F.col("e")).alias("c")).first()
    assert (r["n"], r["c"]) == (count, clean)


def test_scalars(spark):
    sizes = [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (10240, "10 KB"), (1048576, "1.0 MB"), (5 * 1024**3, "5.0 GB")]
    df = spark.createDataFrame(sizes, "n bigint, want string").select(scalars.shown_bytes(F.col("n")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())
    names = ["file10", "File2", "éa", "eb", "file02x"]
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(scalars.natural_key(F.col("n"))).collect()]
    assert got == ["éa", "eb", "File2", "file02x", "file10"]
    versions = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "v1.0.0", "1.2.0", "1.10.0+build"]
    shuffled = spark.createDataFrame([(v,) for v in versions[::-1]], "v string").orderBy(scalars.version_key(F.col("v")))
    assert [r["v"] for r in shuffled.collect()] == versions
    assert spark.createDataFrame([("1.2",), ("x",)], "v string").filter(scalars.version_key(F.col("v")).isNotNull()).count() == 0


def test_shown_sizes_are_those_of_their_sql(spark, tmp_path):
    chars = [*range(1400, 1470), 0, 146, 329, 1353, 2121, 4169, 149_796, 149_797, 1_497_965, 1_498_000, 153_391_690, 160_000_000_000, None]
    spark.createDataFrame(list(enumerate(chars)), "doc_id bigint, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalogue.QUERIES["shown_sizes"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert got == sorted(db.execute(catalogue.ORACLES["shown_sizes"]).fetchall())
    assert dict(got)[chars.index(1353)] == "9.2 KB" and dict(got)[chars.index(2121)] == "14 KB"

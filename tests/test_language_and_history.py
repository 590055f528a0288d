import datetime
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoorless.functions import scalars
from spoorless.operators import language
from spoorless.sources import history

CODES = ["en", "pt-BR", "zh", "zh-TW", "fr"]
PREFIXES = [("pt-br", "pt-BR"), ("zh-tw", "zh-TW"), ("zh-hant", "zh-TW"), ("zh-hant-hk", "zh")]


def test_the_longest_prefix_serves(spark):
    asked = [("fr", "zh"), ("FR", "zh-Hant-TW"), (None, "ZH-HANT-HK-x"), (None, "pt-PT"), (None, "pt-br"), ("", "zh-CN"), (None, None), ("xx", "frank"), (None, "fr-CA"), (None, "zh-t")]
    rows = spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "id int, stored string, wanted string")
    found = language.matched(rows, spark.createDataFrame([(c,) for c in CODES], "code string"), spark.createDataFrame(PREFIXES, "prefix string, code string"))
    assert found.columns == ["id", "stored", "wanted", "code"]
    assert [r["code"] for r in found.orderBy("id").collect()] == ["fr", "zh-TW", "zh", "en", "pt-BR", "zh", "en", "en", "fr", "zh"]
    assert language.matched(rows.limit(0), spark.createDataFrame([], "code string"), spark.createDataFrame([], "prefix string, code string")).count() == 0


def test_rules_in_order_after_exact_entries(spark):
    exact = spark.createDataFrame([("fr", "Clean", "Nettoyer"), ("fr", "Scan", "")], "locale string, text string, shown string")
    rules = spark.createDataFrame([
        ("fr", 2, r"^(\d+) files(?:; (\d+) failed)?\.(?: To: (.*))?$", [(0, "{1} fichiers"), (2, " ; {2} ratés"), (0, "."), (3, " Vers : {3}")]),
        ("fr", 3, r"files", [(0, "trop tard")]), ("fr", 1, r"^0 files\.$", [(0, "aucun fichier")]), ("de", 1, r"^Remove (.*)$", [(0, "{1} entfernen")]),
    ], language.RULES)
    asked = [("fr", "Clean", "Nettoyer"), ("fr", "Scan", "Scan"), ("fr", "0 files.", "aucun fichier"), ("fr", "3 files; 2 failed.", "3 fichiers ; 2 ratés."), ("fr", "3 files. To: {1}$2", "3 fichiers. Vers : {1}$2"), ("fr", "my files", "trop tard"), ("de", "Remove a {2}", "a {2} entfernen"), ("de", "Clean", "Clean"), ("xx", "3 files.", "3 files."), (None, "Clean", "Clean"), ("fr", None, None)]
    found = language.translated(spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "id int, locale string, text string, want string"), exact, rules)
    assert [(r["text"], r["shown"]) for r in found.orderBy("id").collect()] == [(t, w) for _, t, w in asked]


def test_broken_history_lines_are_rows(spark, tmp_path):
    lines = ['{"id": "a", "created_at": "2024-01-02T03:04:05Z", "mode": "replace", "results": [{"path": "/p", "success": true}]}', '{"id": "b"}', "[1, 2", "7", '{"id": "c", "mode": 5, "results": "none"}', "", '{"id": "d", "created_at": "2024-01-02T03:04:05Z", "mode": "other", "more": 1}']
    (tmp_path / "h.json").write_text("\n".join(lines))
    rows = {r["id"] or r["broken"]: r for r in history.read(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b", "d", "[1, 2", "7", lines[4]}
    assert [(rows[k]["mode"], len(rows[k]["results"])) for k in "abd"] == [("replace", 1), ("copy", 0), ("copy", 0)]
    assert all(r["results"] == [] and r["created_at"] is None for r in rows.values() if r["broken"])


def test_settings_fall_back(spark):
    rows = [("u", "mode", "replace"), ("u", "preserve_timestamps", "false"), ("u", "remove_extended_attributes", "yes"), ("v", "mode", None), ("v", "remove_extended_attributes", "true"), ("v", "x", "y")]
    found = {r[0]: tuple(r)[1:] for r in history.settings(spark.createDataFrame(rows, "user string, key string, value string")).collect()}
    assert found == {"u": ("replace", False, True, True, False), "v": ("copy", True, True, True, True)}


def test_iso_dates(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-05-06T23:30:00-01:30", "2024-05-06T00:10:00.5+09:00", "2024-05-06T01:02Z", " 2024-05-06T01:02:03.123456789Z ", "2024-05-06T24:00:00Z", "2024-05-06T01:02:03", "x", "", None, "2024-13-01", "1969-12-31T23:59:59.999Z", "2024-05-06T01:02:03+0100"]
    want = ["2024-02-29T00:00:00.000Z", None, "2024-05-07T01:00:00.000Z", "2024-05-05T15:10:00.500Z", "2024-05-06T01:02:00.000Z", "2024-05-06T01:02:03.123Z", None, None, None, None, None, None, "1969-12-31T23:59:59.999Z", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert [r["u"] for r in rows.select("k", scalars.iso_utc(F.col("t")).alias("u")).orderBy("k").collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.datetimes(datetime.datetime(1902, 1, 1), datetime.datetime(2100, 1, 1), timezones=st.timezones().map(lambda z: z)), min_size=200, max_size=200))
def test_iso_dates_against_the_standard_library(spark, times):
    texts = [t.isoformat() for t in times if re.search(r"[+-]\d\d:\d\d$", t.isoformat())]
    want = [t.astimezone(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z") for t in times if t.isoformat() in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", scalars.iso_utc(F.col("t")).alias("u")).orderBy("k").collect()
    assert [r["u"] for r in rows] == want

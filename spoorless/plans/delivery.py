"""Registered queries of intake, names, sinks, results and languages, with DuckDB SQL for their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import scalars
from ..functions import text as chars
from ..operators import engine, language, naming, queue
from ..schemas import PRIVATE_XATTRS, Options
from ..sinks import committed
from ..sources import history
from . import fixtures as fx
from . import oracle as o
from .registered import register

_PLANTED = f"WITH {o.planted(fx.TRACES)}, {o.judged('ftext', 'j')}"


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and the columns of a file, of planted texts as .txt files."""
    rows = fx.texts(spark, sf_dir).withColumn("content", F.encode("text", "UTF-8"))
    return rows.select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.length("content").cast("long").alias("length"), "content")


# --- sinks and results -------------------------------------------------------------------------------------------------


@register("committed_files", f"{_PLANTED}, {o.cleaned('j', 'k')} SELECT doc_id AS pos, '/out/' || doc_id || '.cleaned.txt' AS output_path, strlen(text) AS output_size, sha256(text) AS sha256 FROM k")
def committed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of a sink's folder after its commit: cleaned texts under the names that they get."""
    rows = fx.texts(spark, sf_dir).filter("text IS NOT NULL")
    name = naming.cleaned_name(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = rows.select(F.col("doc_id").alias("pos"), F.lit(None).cast("string").alias("path"), F.concat(F.lit("/out/"), name).alias("output_path"), F.encode(chars.clean_text(F.col("text")), "UTF-8").alias("cleaned"))
    folder = shared.place(spark, "sink")
    committed.stage(files, folder)
    return committed.listing(spark, folder).select("pos", "output_path", "output_size", "sha256")


@register("delivered_results", f"{_PLANTED}, {o.TEXT_FINDINGS}, asked AS (SELECT doc_id, doc_id * 2 AS pos FROM documents UNION ALL SELECT doc_id, 9000000 - doc_id * 3 FROM documents WHERE doc_id % 3 = 0), "
          "found AS (SELECT doc_id, sum(count) AS n FROM text_found GROUP BY doc_id) "
          "SELECT pos, row_number() OVER (ORDER BY pos) AS place, '/in/' || doc_id || '.txt' AS path, coalesce(n, 0)::BIGINT AS findings FROM asked LEFT JOIN found USING (doc_id)")
def delivered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in the order of their requests; every third path is asked for again, in falling order at the end."""
    files, key = _text_files(spark, sf_dir), F.col("doc_id")
    asked = files.withColumn("pos", key * 2).unionByName(files.filter("doc_id % 3 = 0").withColumn("pos", F.lit(9_000_000) - key * 3))
    reports = queue.delivered(engine.scan(asked.drop("doc_id")))
    return reports.select("pos", "place", "path", queue.residual(F.col("findings")).alias("findings"))


_ATTRIBUTES = [*PRIVATE_XATTRS, "user.note", "com.example.kept"]
_XATTR_SQL = ", ".join(f"CASE WHEN (doc_id >> {k}) % 2 = 1 THEN '{n}' END" for k, n in enumerate(_ATTRIBUTES))


@register("xattr_clean", f"WITH a AS (SELECT doc_id, list_filter([{_XATTR_SQL}], lambda x: x IS NOT NULL) AS names FROM documents), p AS (SELECT doc_id, names, list_filter(names, lambda x: x NOT IN ({', '.join(map(repr, PRIVATE_XATTRS))})) AS kept FROM a) "
          "SELECT doc_id, CAST(len(names) - len(kept) AS BIGINT) AS private, array_to_string(names, ' ') AS kept_all, array_to_string(kept, ' ') AS kept_public, CAST(len(names) - len(kept) AS BIGINT) AS removed FROM p")
def xattr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended attributes, some private, through a scan and through a clean under both options."""
    key = F.col("doc_id")
    each = [F.when(key.bitwiseAND(F.lit(1 << k)) != 0, F.struct(F.lit(n).alias("name"), F.lit(b"v").alias("value"))) for k, n in enumerate(_ATTRIBUTES)]
    content = F.encode(F.concat(F.lit("text "), key.cast("string")), "UTF-8")
    files = fx.table(spark, sf_dir, "documents").select(key.alias("pos"), F.concat(F.lit("/in/"), key.cast("string"), F.lit(".txt")).alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"), F.array_compact(F.array(*each)).alias("xattrs"))
    count = lambda findings: queue.residual(F.filter(findings, lambda f: f["category"] == "macos_xattr"))
    names = F.array_join(F.transform("kept_xattrs", lambda x: x["name"]), " ")
    scanned = engine.scan(files).select("pos", count("findings").alias("private"))
    kept = engine.clean(files).select("pos", names.alias("kept_all"))
    bare = engine.clean(files, Options(remove_extended_attributes=True)).select("pos", names.alias("kept_public"), count("removed").alias("removed"))
    return scanned.join(kept, "pos").join(bare, "pos").withColumnRenamed("pos", "doc_id")


# --- names and intake --------------------------------------------------------------------------------------------------

_WANTED = "w AS (SELECT doc_id AS pos, '/' || source AS folder, 'f' || doc_id % 3 AS stem FROM documents)"
_TAKEN = ("t AS (SELECT '/' || source AS folder, 'f' || doc_id % 3 AS stem, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 2 + doc_id % 19 END AS number FROM documents WHERE doc_id % 2 = 0 "
          "UNION ALL SELECT DISTINCT '/' || source, 'f2', unnest(range(1, 10000)) FROM documents WHERE source IN ('src1', 'src4'))")


@register("free_names", f"WITH {_WANTED}, {_TAKEN}, g AS (SELECT DISTINCT folder, stem FROM w), n AS (SELECT folder, stem, unnest(range(1, 10000)) AS number FROM g), "
          "free AS (SELECT folder, stem, number, row_number() OVER (PARTITION BY folder, stem ORDER BY number) AS r FROM n ANTI JOIN t USING (folder, stem, number)), r AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY pos) AS r FROM w) "
          "SELECT pos, folder, r.stem || '.cleaned.txt' AS name, r.stem || '.cleaned' || CASE WHEN number > 1 THEN '-' || number ELSE '' END || '.txt' AS given FROM r LEFT JOIN free USING (folder, stem, r)")
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of cleaned files that many sources want, where some are taken; of two folders' f2 all are."""
    docs, key = fx.table(spark, sf_dir, "documents"), F.col("doc_id")
    folder = F.concat(F.lit("/"), "source").alias("folder")
    wanted = docs.select(key.alias("pos"), folder, naming.cleaned_name(F.concat(F.lit("f"), (key % 3).cast("string"), F.lit(".txt"))).alias("name"))
    name = lambda stem, number: F.concat(stem, F.lit(".cleaned"), F.when(number > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise(""), F.lit(".txt")).alias("name")
    some = docs.filter("doc_id % 2 = 0").select(folder, name(F.concat(F.lit("f"), (key % 3).cast("string")), F.when(key % 7 == 0, 1).otherwise(2 + key % 19)))
    full = docs.filter(F.col("source").isin("src1", "src4")).select("source").distinct().select(folder, F.explode(F.sequence(F.lit(1), F.lit(naming.MAX_SUFFIX))).alias("n")).select("folder", name(F.lit("f2"), F.col("n")))
    return naming.assigned(wanted, some.unionByName(full))


@register("launch_arguments", "SELECT conv_id, turn FROM conversations JOIN (SELECT conv_id, min(turn) AS low FROM conversations GROUP BY conv_id) USING (conv_id) WHERE turn < low + 3 AND role = 'assistant'")
def launch_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as arguments: the first three of a conversation, and of these those of assistants, as if only they were files."""
    turns = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return queue.first_by_position(turns, 3, "conv_id", pos="turn").filter("role = 'assistant'").select("conv_id", "turn")


_PATHS = ["/in/x/{}.txt", r"c:\in\{}.PDF", "/in/{}/", "{}", "/in/..", "", None]
_PATH_SQL = o.choose("doc_id % 7", ["NULL" if p is None else "'" + p.replace("{}", "' || doc_id || '") + "'" for p in _PATHS])
_PARTS_SQL = {"row_name": ["doc_id || '.txt'", "doc_id || '.PDF'", "path", "path", "'..'", "''", "NULL"], "kind": ["'text'", "'pdf'", "'unknown'", "'unknown'", "'unknown'", "'unknown'", "'unknown'"],
              "shown": ["doc_id || '.txt'", "path", "doc_id::VARCHAR", "path", f"'{naming.UNKNOWN_NAME}'", f"'{naming.UNKNOWN_NAME}'", f"'{naming.UNKNOWN_NAME}'"]}


@register("row_identity", f"WITH p AS (SELECT doc_id, n_chars, {_PATH_SQL} AS path FROM documents) SELECT doc_id, path AS id, " + ", ".join(f"{o.choose('doc_id % 7', v)} AS {k}" for k, v in _PARTS_SQL.items()) + ", 'f' || doc_id || '.txt:' || n_chars || ':' || (doc_id * 1000) AS file_id FROM p")
def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and names of rows known by path, and ids of those known by name, size and time; some paths have no name."""
    key = F.col("doc_id")
    path = F.element_at(F.array(*[F.lit(None).cast("string") if p is None else F.replace(F.lit(p), F.lit("{}"), key.cast("string")) for p in _PATHS]), (key % 7 + 1).cast("int"))
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars", path.alias("path"))
    file = naming.file_row(F.concat(F.lit("f"), key.cast("string"), F.lit(".txt")), F.col("n_chars"), key * 1000)
    rows = rows.select("doc_id", naming.path_row(F.col("path")).alias("r"), naming.report_name(F.col("path")).alias("shown"), file.alias("f"))
    return rows.select("doc_id", "r.id", F.col("r.name").alias("row_name"), "r.kind", "shown", F.col("f.id").alias("file_id"))


# --- what was kept of earlier runs -------------------------------------------------------------------------------------

_LINE_SQL = "event_id % 7 <> 0 AND event_id % 11 <> 0"


@register("history_read", f"SELECT CASE WHEN {_LINE_SQL} THEN 'h' || event_id END AS id, CASE WHEN {_LINE_SQL} AND event_type = 'click' THEN 'replace' ELSE 'copy' END AS mode, CASE WHEN {_LINE_SQL} THEN event_id % 3 ELSE 0 END AS results, NOT ({_LINE_SQL}) AS broken FROM events")
def history_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a history, some cut off and some of another shape, written as text and read tolerantly."""
    key = F.col("event_id")
    result = '{"path": "/p", "success": true}'
    results = F.array_join(F.array_repeat(F.lit(result), (key % 3).cast("int")), ", ")
    mode = F.when(F.col("event_type") == "click", "replace").otherwise(F.col("event_type"))
    line = F.concat(F.lit('{"id": "h'), key.cast("string"), F.lit('", "mode": "'), mode, F.lit('", "results": ['), results, F.lit("]}"))
    line = F.when(key % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).when(key % 11 == 0, F.lit("[1, 2]")).otherwise(line)
    path = shared.place(spark, "history")
    fx.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return history.read(spark, path).select("id", "mode", F.size("results").cast("long").alias("results"), F.col("broken").isNotNull().alias("broken"))


@register("settings_read", "WITH e AS (SELECT user_id, event_id % 5 AS k, CASE event_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE 'replace' END AS v FROM events), m AS (SELECT user_id, k, max(v) AS v FROM e GROUP BY user_id, k) "
          "SELECT user_id, coalesce(max(v) FILTER (k = 0), '') = 'replace' AS replaces, coalesce(max(v) FILTER (k = 1), '') <> 'false' AS preserve_timestamps, coalesce(max(v) FILTER (k = 2), '') <> 'false' AS preserve_color_profile, coalesce(max(v) FILTER (k = 3), '') = 'true' AS remove_extended_attributes FROM m GROUP BY user_id")
def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as settings of their users: a key and a text each, some missing, some of no meaning."""
    key = F.col("event_id")
    rows = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), fx.pick(key % 5, ["mode", "preserve_timestamps", "preserve_color_profile", "remove_extended_attributes", "other"]).alias("key"), fx.pick(key % 3, ["false", "true", "replace"]).alias("value"))
    return history.settings(rows).select(F.col("user").alias("user_id"), (F.col("mode") == "replace").alias("replaces"), "preserve_timestamps", "preserve_color_profile", "remove_extended_attributes")


# --- languages and dates -----------------------------------------------------------------------------------------------

_CODES = ["en", "de", "fr", "pt-BR", "zh", "zh-TW"]
_PREFIXES = {"pt-br": "pt-BR", "zh-tw": "zh-TW", "zh-hk": "zh-TW", "zh-mo": "zh-TW", "zh-hant": "zh-TW"}
_TAGS = ["{}-AT", "{}", "PT-br", "zh-Hant-{}", "ZH-mo", "zh-Hans", "x-{}"]
_TAG_SQL = o.choose("doc_id % 7", ["'" + t.replace("{}", "' || lang || '") + "'" for t in _TAGS])
_VALUES = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{c}'" for c in r) + ")" for r in rows) + ")"


@register("locale_match", f"WITH r AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'fr' WHEN 1 THEN 'FR' END AS stored, {_TAG_SQL} AS wanted FROM documents), c(code) AS {_VALUES([(c,) for c in _CODES])}, p(prefix, code) AS {_VALUES(_PREFIXES.items())} "
          "SELECT id, stored, wanted, coalesce((SELECT code FROM c WHERE code = stored), (SELECT code FROM p WHERE starts_with(lower(wanted), prefix) ORDER BY length(prefix) DESC LIMIT 1), (SELECT code FROM c WHERE code = string_split(lower(wanted), '-')[1]), 'en') AS code FROM r")
def locale_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored choice, else the longest prefix of a browser's tag, else its language, else English."""
    key = F.col("doc_id")
    tag = F.replace(fx.pick(key % 7, _TAGS), F.lit("{}"), F.col("lang"))
    asked = fx.table(spark, sf_dir, "documents").select(key.alias("id"), F.when(key % 5 == 0, "fr").when(key % 5 == 1, "FR").alias("stored"), tag.alias("wanted"))
    return language.matched(asked, spark.createDataFrame([(c,) for c in _CODES], "code string"), spark.createDataFrame(list(_PREFIXES.items()), "prefix string, code string"))


_SHOWN = [("de", "Nothing to do", "Nichts zu tun"), ("fr", "Nothing to do", "Rien à faire"), ("es", "Nothing to do", "")]
_RULES = [
    ("de", 1, "^0 files", [(0, "keine Dateien")]), ("de", 2, r"^(\d+) files(?:, (\d+) broken)?$", [(0, "{1} Dateien"), (2, ", davon {2} defekt")]),
    ("fr", 1, r"^(\d+) files(?:, (\d+) broken)?$", [(0, "{1} fichiers"), (2, ", dont {2} abîmés")]), ("fr", 2, "^Opened (.+)$", [(0, "{1} est ouvert")]), ("fr", 3, "^Opened", [(0, "trop tard")]),
]
_SAID_SQL = o.choose("doc_id % 5", ["'Nothing to do'", "n_chars || ' files'", "n_chars || ' files, ' || doc_id || ' broken'", "'Opened ' || source", "(n_chars * 0) || ' files'"])
_SHOWN_SQL = {
    "de": ["'Nichts zu tun'", "CASE WHEN n_chars = 0 THEN 'keine Dateien' ELSE n_chars || ' Dateien' END", "CASE WHEN n_chars = 0 THEN 'keine Dateien' ELSE n_chars || ' Dateien, davon ' || doc_id || ' defekt' END", "text", "'keine Dateien'"],
    "fr": ["'Rien à faire'", "n_chars || ' fichiers'", "n_chars || ' fichiers, dont ' || doc_id || ' abîmés'", "source || ' est ouvert'", "'0 fichiers'"],
}


@register("translated_texts", f"WITH s AS (SELECT doc_id, lang AS locale, n_chars, source, {_SAID_SQL} AS text FROM documents) SELECT doc_id, locale, text, CASE locale " + " ".join(f"WHEN '{k}' THEN {o.choose('doc_id % 5', v)}" for k, v in _SHOWN_SQL.items()) + " ELSE text END AS shown FROM s")
def translated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made of documents' columns, by entries and by ordered rules, both tables."""
    key = F.col("doc_id")
    size = F.col("n_chars").cast("string")
    said = [F.lit("Nothing to do"), F.concat(size, F.lit(" files")), F.concat(size, F.lit(" files, "), key.cast("string"), F.lit(" broken")), F.concat(F.lit("Opened "), "source"), F.lit("0 files")]
    texts = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("locale"), F.element_at(F.array(*said), (key % 5 + 1).cast("int")).alias("text"))
    return language.translated(texts, spark.createDataFrame(_SHOWN, "locale string, text string, shown string"), spark.createDataFrame(_RULES, language.RULES))


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


@register("iso_dates", "WITH t AS (SELECT o_orderkey AS k, (1960 + o_orderkey % 97) || '-' || lpad((1 + o_orderkey % 13)::VARCHAR, 2, '0') || '-' || lpad((1 + o_orderkey % 31)::VARCHAR, 2, '0') AS d, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 59)::VARCHAR, 2, '0') || ':07' AS h FROM orders), "
          "u AS (SELECT k, try_strptime(d || ' ' || h, '%Y-%m-%d %H:%M:%S') AS moment, try_strptime(d, '%Y-%m-%d') AS day FROM t) "
          "SELECT k AS o_orderkey, strftime(CASE k % 5 WHEN 0 THEN day WHEN 1 THEN moment WHEN 2 THEN moment - INTERVAL 330 MINUTE WHEN 3 THEN moment + INTERVAL 1 MINUTE * (60 * (k % 12) + 45) + INTERVAL 250 MILLISECOND END, '%Y-%m-%dT%H:%M:%S.%gZ') AS utc FROM u")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and times with offsets, made of orders' keys; a thirteenth month, a thirtieth of February and times without offset are none."""
    key = F.col("o_orderkey")
    day = F.concat_ws("-", (key % 97 + 1960).cast("string"), _two(key % 13 + 1), _two(key % 31 + 1))
    at = F.concat(day, F.lit("T"), _two(key % 24), F.lit(":"), _two(key % 59), F.lit(":07"))
    text = F.when(key % 5 == 0, day).when(key % 5 == 1, F.concat(at, F.lit("Z"))).when(key % 5 == 2, F.concat(at, F.lit("+05:30"))).when(key % 5 == 3, F.concat(at, F.lit(".25-"), _two(key % 12), F.lit(":45"))).otherwise(at)
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", scalars.iso_utc(text).alias("utc"))

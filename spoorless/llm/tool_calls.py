"""Chat formatting (native): link tool calls to results, order them, validate arguments, serialise canonically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, load

#: Argument types of a tool: name -> (JSON type, whether it must be there).
Schema = dict[str, tuple[str, bool]]

#: The tools that the registered query's exchanges call.
TURNS: dict[str, Schema] = {
    "reply": {"conv": ("integer", True), "prompt": ("string", True), "turn": ("integer", True)},
    "note": {"conv": ("integer", True), "role": ("string", False), "text": ("string", True), "turn": ("integer", True)},
}

_TYPES = {"integer": "(BIGINT|DECIMAL\\(\\d+,0\\))", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def canonical(json: Column) -> Column:
    """JSON text with keys in order and no white space; null if it is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def problems(name: Column, arguments: Column, tools: dict[str, Schema]) -> Column:
    """What is wrong with a call's arguments, in order of argument; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    found = F.array(F.concat(F.lit("unknown tool: "), F.coalesce(name, F.lit("null"))))
    for tool, schema in sorted(tools.items()):
        checks = []
        for argument, (kind, needed) in sorted(schema.items()):
            got = F.schema_of_variant(F.try_variant_get(parsed, f"$.{argument}", "variant"))
            if needed:
                checks.append(F.when(got.isNull() | (got == "VOID"), F.lit(f"missing: {argument}")))
            checks.append(F.when((got != "VOID") & ~got.rlike(f"^{_TYPES[kind]}$"), F.lit(f"not {kind}: {argument}")))
        unknown = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(a) for a in sorted(schema)])))
        extra = F.transform(unknown, lambda k: F.concat(F.lit("unexpected: "), k))
        of_tool = F.when(parsed.isNull() | ~F.coalesce(is_object, F.lit(False)), F.array(F.lit("arguments are no object"))).otherwise(F.concat(F.array_compact(F.array(*checks)), extra))
        found = F.when(name == tool, of_tool).otherwise(found)
    return found


def levels(calls: DataFrame) -> DataFrame:
    """``call_id, level``: how many calls stand above each one; -1 on and below a cycle.

    ``call_id, parent_id`` in. Parents that are no calls count as none. Pointers are doubled, so a chain of
    n calls takes about log2(n) joins on identifiers; nothing is gathered by conversation.
    """
    known = calls.filter("call_id IS NOT NULL").groupBy("call_id").agg(F.min("parent_id").alias("up"))
    real = known.select(F.col("call_id").alias("up"), F.lit(True).alias("real"))
    known = known.join(real, "up", "left").select("call_id", F.when(F.col("real"), F.col("up")).alias("up"))
    state = cut(known.withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")))
    count = state.count()
    rounds = 0
    while not state.filter("up IS NOT NULL").isEmpty() and 2**rounds <= 2 * count:
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        state = cut(state.join(above, "up", "left").select("call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        rounds += 1
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("level")).otherwise(-1).alias("level"))


def link(calls: DataFrame, results: DataFrame, tools: dict[str, Schema]) -> DataFrame:
    """Tool calls with their results, in an order in which every call follows the call that it depends on.

    ``calls``: ``conv_id, call_id, parent_id, name, arguments`` (JSON text); ``results``: ``call_id,
    content``. Returns a row a call: ``conv_id, call_id, level`` (sorting a conversation by level and
    call_id is a topological order; -1: a cycle), ``has_result, valid, problems`` (joined by "; "), ``json``
    (canonical; arguments that are no JSON are carried as a string). Of several results of an identifier
    the least text counts; a null identifier links with nothing; repeated calls give a row each; empty tables
    give no rows; other columns are not read.
    """
    calls = calls.select("conv_id", "call_id", "parent_id", "name", "arguments")
    one = results.filter("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct(F.col("content"))).alias("result"))
    joined = calls.join(one.hint("shuffle_hash"), "call_id", "left").join(levels(calls).hint("shuffle_hash"), "call_id", "left")
    wrong = problems(F.col("name"), F.col("arguments"), tools)
    text = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]"))
    value = lambda c: F.expr("1") if c is None else F.regexp_extract(text(c), r"(?s)^\[(.*)\]$", 1)
    arguments = F.coalesce(canonical(F.col("arguments")), value(F.col("arguments")))
    result = F.when(F.col("result").isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"content":'), value(F.col("result.content")), F.lit("}")))
    level = F.coalesce("level", F.lit(0))
    parts = [
        '{"arguments":', arguments, ',"call_id":', value(F.col("call_id")), ',"level":', level.cast("string"),
        ',"name":', value(F.col("name")), ',"result":', result, "}",
    ]
    json = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return joined.select("conv_id", "call_id", level.alias("level"), F.col("result").isNotNull().alias("has_result"), (F.size(wrong) == 0).alias("valid"), F.array_join(wrong, "; ").alias("problems"), json.alias("json"))


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of ``conv_id, turn, role, text`` as calls and results.

    A user's turn calls the tool "reply"; the assistant's next turn is its result, and the user's turn
    before that is the call it depends on. Identifiers are conversation and turn. Every other turn (of
    another role or none, or an assistant's that answers no user's) calls the tool "note", with no result.
    """
    name = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    told = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn"), F.col("conv_id").alias("conv")))
    calls = conversations.filter("role = 'user'").select("conv_id", F.when(known, name(0)).alias("call_id"), F.when(known, name(2)).alias("parent_id"), F.lit("reply").alias("name"), told.alias("arguments"))
    answers = conversations.filter("role = 'assistant'").select("conv_id", "turn", "role", "text", F.when(known, name(1)).alias("call_id"))
    asked = calls.select("call_id").distinct().hint("shuffle_hash")
    others = conversations.filter("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    others = others.union(answers.join(asked, "call_id", "left_anti").select("conv_id", "turn", "role", "text"))
    noted = F.to_json(F.struct("role", "text", "turn", F.col("conv_id").alias("conv")))
    notes = others.select("conv_id", F.when(known, F.concat(F.lit("note:"), name(0))).alias("call_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("note").alias("name"), noted.alias("arguments"))
    return calls.union(notes), answers.select("call_id", F.col("text").alias("content"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = exchanges(load(spark, sf_dir, "conversations"))
    return link(calls, results, TURNS)


ORACLE = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id || ':' || (turn - 1) AS call_id, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1),
levels(conv_id, turn, level) AS (
  SELECT DISTINCT conv_id, turn, 0 FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION SELECT c.conv_id, c.turn, l.level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2)
SELECT c.conv_id, c.call_id, CAST(l.level AS BIGINT) AS level, r.call_id IS NOT NULL AS has_result, c.text IS NOT NULL AS valid,
  CASE WHEN c.text IS NULL THEN 'missing: prompt' ELSE '' END AS problems,
  '{"arguments":{"conv":' || c.conv_id || CASE WHEN c.text IS NULL THEN '' ELSE ',"prompt":' || CAST(to_json(c.text) AS VARCHAR) END || ',"turn":' || c.turn
    || '},"call_id":"' || c.call_id || '","level":' || l.level || ',"name":"reply","result":'
    || CASE WHEN r.call_id IS NULL THEN 'null' ELSE '{"content":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' END || '}' AS json
FROM calls c JOIN levels l USING (conv_id, turn) LEFT JOIN results r ON r.call_id = c.call_id
UNION ALL
SELECT conv_id, 'note:' || conv_id || ':' || turn, 0, false, text IS NOT NULL, CASE WHEN text IS NULL THEN 'missing: text' ELSE '' END,
  '{"arguments":{"conv":' || conv_id || coalesce(',"role":' || CAST(to_json(role) AS VARCHAR), '') || CASE WHEN text IS NULL THEN '' ELSE ',"text":' || CAST(to_json(text) AS VARCHAR) END || ',"turn":' || turn
    || '},"call_id":"note:' || conv_id || ':' || turn || '","level":0,"name":"note","result":null}'
FROM conversations o
WHERE role IS NULL OR role NOT IN ('user', 'assistant') OR role = 'assistant' AND NOT EXISTS (SELECT 1 FROM calls u WHERE u.conv_id = o.conv_id AND u.turn = o.turn - 1)
"""

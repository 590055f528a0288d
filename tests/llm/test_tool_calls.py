import json

from spoorless.llm import tool_calls as tc

TOOLS = {"sum": {"x": ("integer", True), "note": ("string", False)}, "ping": {}}
CALLS = [
    (1, "a", None, "sum", '{"x": 1, "note": "n"}'), (1, "b", "a", "sum", '{"note":"é\\"\\n","x":2}'), (1, "c", "b", "sum", '{"x":"2"}'), (1, "d", "zz", "sum", "{}"),
    (2, "e", "f", "ping", "{}"), (2, "f", "e", "ping", '{"y":1}'), (2, "g", "f", "nope", "[1]"), (3, "h", None, "ping", "no json"), (3, None, None, "ping", None), (3, "h", None, "ping", "{}"),
]
RESULTS = [("a", "one"), ("a", "another"), ("b", None), (None, "lost"), ("zz", "no call")]


def test_linking_order_validation_and_canonical_json(spark):
    calls = spark.createDataFrame([(*c, "x") for c in CALLS], "conv_id long, call_id string, parent_id string, name string, arguments string, level string")
    results = spark.createDataFrame(RESULTS, "call_id string, content string")
    rows = tc.link(calls, results, TOOLS).collect()
    assert len(rows) == len(CALLS)
    by = {(r["call_id"], r["problems"]): r for r in rows}
    level = {r["call_id"]: r["level"] for r in rows}
    assert level == {"a": 0, "b": 1, "c": 2, "d": 0, "e": -1, "f": -1, "g": -1, "h": 0, None: 0}
    told = {(r["call_id"], r["valid"], r["problems"]) for r in rows}
    assert told == {("a", True, ""), ("b", True, ""), ("c", False, "not integer: x"), ("d", False, "missing: x"), ("e", True, ""), ("f", False, "unexpected: y"), ("g", False, "unknown tool: nope"),
                    ("h", False, "arguments are no object"), ("h", True, ""), (None, False, "arguments are no object")}
    for r in rows:
        j = json.loads(r["json"])
        assert r["json"] == json.dumps(j, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(by["a", ""]["json"])["result"] == {"content": "another"} and json.loads(by["b", ""]["json"])["result"] == {"content": None}
    assert json.loads(by["c", "not integer: x"]["json"])["result"] is None and json.loads(by["h", "arguments are no object"]["json"])["arguments"] == "no json"


def test_every_turn_is_told(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "assistant", "more"), (1, 4, None, "x"), (None, 5, "assistant", "lost"), (2, 0, "tool", None)]
    calls, results = tc.exchanges(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = {r["call_id"]: r for r in tc.link(calls, results, tc.TURNS).collect()}
    assert set(rows) == {"1:1", "note:1:0", "note:1:3", "note:1:4", None, "note:2:0"}
    assert json.loads(rows["1:1"]["json"])["result"] == {"content": "hello"}
    assert json.loads(rows["note:1:0"]["json"])["arguments"] == {"conv": 1, "role": "system", "text": "rules", "turn": 0}
    assert rows["note:1:4"]["valid"] and rows["note:2:0"]["problems"] == "missing: text" and rows[None]["problems"] == "missing: conv"


def test_long_chain_and_empty_tables(spark):
    schema = "conv_id long, call_id string, parent_id string, name string, arguments string"
    chain = spark.createDataFrame([(1, f"{i}", f"{i - 1}", "ping", "{}") for i in range(60)], schema)
    none = spark.createDataFrame([], "call_id string, content string")
    assert {r["call_id"]: r["level"] for r in tc.link(chain, none, TOOLS).collect()} == {f"{i}": i for i in range(60)}
    assert tc.link(chain.limit(0), none, TOOLS).count() == 0

import json

from tallyglass.llm import toolcalls as t

CALLS = "conv long, turn long, id string, tool string, arguments string, after string, content string, r string"
RESULTS = "conv long, turn long, id string, content string, depth int"
TOOLS = {"add": {"a": ("number", True, None), "b": ("number", True, 0), "note": ("string", False, 1)}, "list": {"items": ("array", True, None), "deep": ("boolean", False, None)}, "none": {}}


def _link(spark, calls, results, tools=TOOLS):
    got = t.link(spark.createDataFrame([(*c, "x", "y") for c in calls], CALLS), spark.createDataFrame([(*r, 1) for r in results], RESULTS), tools)
    assert not any(w in got._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))
    return got.collect()


def test_links_statuses_and_json(spark):
    rows = _link(spark, [
        (1, 1, "a", "add", '{"b": 2, "a": 1.5}', None), (1, 2, "b", "add", '{"a":"x","b":-1,"c":0,"note":""}', "a"), (1, 3, "c", "list", '{"items":[{"z":1,"y":2}],"deep":true}', "b"),
        (1, 4, "d", "list", "not json", "zz"), (1, 5, "e", "what", "{}", None), (1, 6, "f", "none", "[1]", None), (1, 7, "a", "add", '{"a":1,"b":1}', None),
        (2, 1, "a", "none", "{}", None), (2, 1, None, "none", None, None), (None, 1, "a", "none", "{}", "a"), (2, 1, "a", "none", "{}", None)], [
        (1, 9, "a", 'said "so"\n'), (1, 8, "a", "first"), (1, 9, "c", None), (1, 9, "orphan", "x"), (3, 1, "a", "x")])
    by = {(r["conv"], r["turn"], r["id"], r["status"]): r for r in rows}
    assert len(rows) == 11
    ok = by[1, 1, "a", "ok"]
    assert ok["json"] == '{"arguments":{"a":1.5,"b":2},"id":"a","result":"first","tool":"add"}' and ok["depth"] == 0
    bad = by[1, 2, "b", "invalid"]
    assert bad["problems"] == "a is no number; b below 0; note below 1; unknown c" and bad["depth"] == 1
    deep = by[1, 3, "c", "ok"]
    assert deep["depth"] == 2 and json.loads(deep["json"]) == {"arguments": {"deep": True, "items": [{"y": 2, "z": 1}]}, "id": "c", "result": "", "tool": "list"}
    assert by[1, 4, "d", "invalid"]["problems"] == "not an object" and by[1, 4, "d", "invalid"]["depth"] == 0
    assert by[1, 4, "d", "invalid"]["json"] == '{"arguments":"not json","id":"d","result":null,"tool":"list"}'
    assert by[1, 5, "e", "invalid"]["problems"] == "unknown tool" and by[1, 6, "f", "invalid"]["problems"] == "not an object"
    assert by[1, 7, "a", "duplicate"]["tool"] == "add"
    assert sorted(r["status"] for r in rows if r["conv"] == 2) == ["duplicate", "invalid", "unanswered"]
    assert by[None, 1, "a", "unanswered"]["depth"] == 0


def test_order_of_long_chains_and_cycles(spark):
    calls = [(7, 300 - i, f"n{i}", "none", "{}", f"n{i - 1}" if i else None) for i in range(200)]
    calls += [(8, 1, "p", "none", "{}", "q"), (8, 2, "q", "none", "{}", "p"), (8, 3, "r", "none", "{}", "q"), (8, 4, "s", "none", "{}", "s")]
    rows = _link(spark, calls, [])
    depth = {(r["conv"], r["id"]): r["depth"] for r in rows}
    assert [depth[7, f"n{i}"] for i in range(200)] == list(range(200))
    assert {r["id"]: r["status"] for r in rows if r["conv"] == 8} == dict.fromkeys("pqrs", "cycle")


def test_empty_tables_and_orphans(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([(1, 1, "a", "x", 1)], RESULTS)
    assert t.link(calls, results, TOOLS).count() == 0
    assert [r["id"] for r in t.orphans(calls, results).collect()] == ["a"]
    assert t.link(calls, results.limit(0), {}).count() == 0


def test_plain_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind", 1), (1, 1, "user", "hi\t\"there\"", 1), (1, 2, "assistant", "ho", 1), (1, 3, "user", None, 1), (2, 0, "user", "x" * 300_000, 1),
                                   (2, 1, "assistant", None, 1), (2, 1, "assistant", "late", 1), (3, 0, None, "?", 1), (4, 5, "user", "again", 1), (4, 5, "user", "again", 1)],
                                  "conv_id long, turn long, role string, text string, depth int")
    got = {(r["conv"], r["turn"], r["status"]): r for r in t.link(*t.from_turns(turns), t.CHAT_TOOLS).collect()}
    assert sorted(got) == [(1, 0, "unanswered"), (1, 1, "ok"), (1, 3, "invalid"), (2, 0, "ok"), (4, 5, "duplicate"), (4, 5, "unanswered")]
    assert [got[k]["depth"] for k in sorted(got)] == [0, 1, 2, 0, 0, 0]
    assert got[1, 1, "ok"]["json"] == '{"arguments":{"text":"hi\\t\\"there\\"","turn":1},"id":"call-1","result":"ho","tool":"reply"}'
    assert json.loads(got[2, 0, "ok"]["json"])["arguments"]["text"] == "x" * 300_000

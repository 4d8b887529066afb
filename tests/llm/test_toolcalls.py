import json
import random

from siltworks.llm import toolcalls
from siltworks.llm.toolcalls import Tool
from tests.oracle import duck, same_rows

TOOLS = (Tool("add", {"x": "integer", "y": "number", "note": "string"}, ("x",)), Tool("look", {"at": "object", "tags": "array", "deep": "boolean"}))


def link(spark, messages):
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as level", "'clash' as status")
    return {(r.conv_id, r.call_id): r for r in toolcalls.link_tool_calls(df, TOOLS).collect()}


def call(i, name="add", arguments=None, depends_on=None):
    return {"id": i, "name": name, "arguments": {"x": 1} if arguments is None else arguments, **({"depends_on": depends_on} if depends_on else {})}


def said(*calls):
    return json.dumps({"tool_calls": list(calls), "content": "working"})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_linking_and_order(spark):
    out = link(spark, [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", said(call("c", depends_on=["b", "a"]), call("b", depends_on=["a"]), call("a", arguments={"y": 2.5, "x": 1}))),
        (1, 2, "tool", result("a", {"z": 1, "b": [1, 2]})), (1, 3, "tool", result("b", "é\n\"")), (1, 4, "tool", result("c", None)), (1, 5, "tool", result("c", "again")),
        (2, 1, "assistant", said(call("a"))), (2, 2, "tool", result("ghost", 1)),
    ])
    assert [(out[1, x].level, out[1, x].status, out[1, x].n_results) for x in "abc"] == [(0, "ok", 1), (1, "ok", 1), (2, "ok", 2)]
    assert out[1, "a"].record == '{"arguments":{"x":1,"y":2.5},"id":"a","name":"add","result":{"b":[1,2],"z":1}}'
    assert json.loads(out[1, "b"].record)["result"] == 'é\n"' and json.loads(out[1, "c"].record)["result"] is None
    assert (out[2, "a"].status, out[2, "ghost"].status, out[2, "ghost"].record) == ("missing_result", "orphan_result", None)


def test_arguments_against_schemas(spark):
    cases = [({"x": 1}, "ok"), ({"x": "1"}, "bad"), ({"x": 1.5}, "bad"), ({}, "bad"), ({"x": 1, "z": 1}, "bad"), ({"x": 1, "y": 3, "note": "n"}, "ok"), ({"x": 1, "note": None}, "bad"), ([1], "bad"), ("text", "bad")]
    messages = [(1, 0, "assistant", said(*[call(f"k{i}", arguments=a) for i, (a, _) in enumerate(cases)], call("u", name="fly"), call("o", "look", {"at": {"a": 1}, "tags": [], "deep": True})))]
    messages += [(1, 1, "tool", result(f"k{i}", 1)) for i in range(len(cases))] + [(1, 1, "tool", result("o", 1)), (1, 1, "tool", result("u", 1))]
    out = link(spark, messages)
    assert [("ok" if out[1, f"k{i}"].status == "ok" else "bad") for i in range(len(cases))] == [want for _, want in cases]
    assert (out[1, "u"].status, out[1, "o"].status) == ("unknown_tool", "ok")


def test_cycles_and_missing_dependencies(spark):
    out = link(spark, [(1, 0, "assistant", said(call("a", depends_on=["b"]), call("b", depends_on=["a"]), call("c", depends_on=["a"]), call("d", depends_on=["zzz"]), call("e"), call("s", depends_on=["s"])))])
    assert {x: out[1, x].level for x in "abcdes"} == {"a": None, "b": None, "c": None, "d": None, "e": 0, "s": None}
    assert out[1, "a"].status == "unordered" and out[1, "e"].status == "missing_result"


def test_odd_rows(spark):
    out = link(spark, [
        (None, 0, "assistant", said(call("n"))), (None, 1, "tool", result("n", 1)), (1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", "{broken"), (1, 0, "assistant", ""),
        (1, 0, "assistant", '{"tool_calls": 5}'), (1, 0, "assistant", '{"tool_calls": [5, {"name": "add"}]}'), (1, 1, "tool", '{"content": 1}'), (1, 5, "assistant", said(call("late"))), (1, 3, "tool", result("late", 1)),
        (3, 2, "assistant", said(call("r", arguments={"x": 2}))), (3, 1, "assistant", said(call("r", arguments={"x": 1}))), (3, 1, "assistant", said(call("r", arguments={"x": 1}))),
    ])
    assert out[None, "n"].status == "ok" and out[1, "late"].status == "early_result"
    assert json.loads(out[3, "r"].record)["arguments"] == {"x": 1} and len(out) == 3
    assert link(spark, []) == {}


def test_levels_of_random_graphs(spark):
    """Levels by brute force: chains, diamonds, cycles and repeated dependencies over several conversations."""
    import random

    rng = random.Random(11)
    messages, wanted = [], {}
    for conv in (1, 2, None):
        names = [f"c{i}" for i in range(25)]
        needs = {n: [rng.choice(names[:i]) for _ in range(rng.choice([0, 1, 1, 2, 3]))] if i else [] for i, n in enumerate(names)}
        needs |= {f"chain{i}": [f"chain{i - 1}"] if i else [] for i in range(12)}
        if conv == 2:
            needs["c0"] = ["c24", "c1"]
        messages += [(conv, k, "assistant", said(call(n, depends_on=d))) for k, (n, d) in enumerate(rng.sample(sorted(needs.items()), len(needs)))]
        level: dict = {}
        while ready := {n: max((level[d] + 1 for d in ds), default=0) for n, ds in needs.items() if n not in level and all(d in level for d in ds)}:
            level |= ready
        wanted |= {(conv, n): level.get(n) for n in needs}
    out = link(spark, messages)
    assert {k: r.level for k, r in out.items()} == wanted and max(v for v in wanted.values() if v is not None) >= 11


def test_white_space_odd_names_and_long_texts(spark):
    tools = (Tool("add", {"a.b": "integer", "it's": "string", 'say "x"': "number", "[0]": "boolean"}, ("a.b",)),)
    given = [{"a.b": 1, "it's": "x", 'say "x"': 2.5, "[0]": True}, {"a.b": "1"}, {"it's": "x"}, {"a.b": 1, "it's": 3}, {"a.b": 1, "[0]": 1}]
    text = "\n\t\r " + said(*[call(f"k{i}", arguments=a) for i, a in enumerate(given)])
    long = "x y " * 300_000
    rows = [(1, 0, "assistant", text), (1, 1, "tool", " \n" + result("k0", long)), (1, 2, "tool", "\u00a0" + result("k0", 1))]
    out = {r.call_id: r for r in toolcalls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()}
    assert [out[f"k{i}"].status for i in range(5)] == ["ok"] + ["invalid_arguments"] * 4 and out["k0"].n_results == 1
    assert json.loads(out["k0"].record)["result"] == long


def test_conversations_match_sql(spark, small):
    same_rows(toolcalls.chat_report(spark.read.parquet(f"{small}/conversations.parquet")), duck(small), toolcalls.ORACLE_SQL)


def test_no_python_on_the_way(spark, small):
    plan = toolcalls.chat_report(spark.read.parquet(f"{small}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def some_calls(rng, conversations, most):
    rows = []
    for c in range(conversations):
        n = rng.randrange(1, most)
        for i in range(n):
            needs = rng.choice([None, [], [f"k{rng.randrange(n)}"], [f"k{max(0, i - 1)}"] if i else [], [f"k{rng.randrange(i)}" for _ in range(3)] if i else [], ["ghost"] if rng.random() < 0.1 else [], [None] if rng.random() < 0.1 else []])
            rows.append((c if c else None, f"k{i}", needs))
    return rows


def levels_of(rows):
    out = {}
    while True:
        new = {(c, i): 1 + max((out[c, d] for d in set(needs or [])), default=-1) for c, i, needs in rows if (c, i) not in out and all((c, d) in out for d in needs or [])}
        if not new:
            return out
        out |= new


def test_levels_in_rows_and_by_rounds_agree(spark):
    rows = some_calls(random.Random(3), 40, 14)
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    for in_row in (0, 6, 512):
        found = {(r.conv_id, r.call_id): r.level for r in toolcalls.topological_levels(calls, in_row).collect()}
        assert found == levels_of(rows), in_row
    assert toolcalls.topological_levels(calls.limit(0)).count() == 0


def test_a_chain_of_calls_takes_a_few_jobs(spark):
    rows = [(1, f"k{i}", [f"k{i - 1}"] if i else []) for i in range(500)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    found = {r.call_id: r.level for r in toolcalls.topological_levels(calls).collect()}
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext._jsc.clearJobGroup()
    assert found == {f"k{i}": i for i in range(500)} and jobs <= 20

import json
import random
import time

import pytest
from oracle import assert_same

from corpusmill.llm import chat_format as C

TOOLS = {"add": {"required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0, "maximum": 9}, "s": {"type": "string", "minLength": 2, "maxLength": 3}, "e": {"enum": ["x", "y"]}, "o": {"type": "object"}, "n": {"type": "number"}, "l": {"type": "array"}, "b": {"type": "boolean"}}, "additionalProperties": False}}


def linked(spark, calls, results, tools=TOOLS):
    rows = C.link_calls(spark.createDataFrame(calls, C.CALLS), spark.createDataFrame(results, C.RESULTS), tools).collect()
    return rows


def call(conv, turn, cid, args='{"a":1}', after=(), name="add", place=0):
    return (conv, turn, place, cid, name, args, list(after))


def test_query_is_the_sql(spark, tiny):
    assert_same(C.op3(spark, tiny), C.ORACLE, tiny)


def test_status(spark):
    rows = linked(spark, [call(1, 0, "a"), call(1, 2, "b"), call(1, 4, "a"), call(None, 0, "a"), call(2, 0, None)], [(1, 1, "a", "r1"), (1, 3, "a", "r2"), (1, 5, "zz", "r"), (2, 1, None, None)])
    got = sorted((str(r.conv_id), r.turn, r.status) for r in rows)
    assert got == sorted([("1", 0, "linked"), ("1", 2, "unanswered"), ("1", 4, "repeated"), ("None", 0, "unanswered"), ("2", 0, "unanswered"), ("1", 3, "repeated"), ("1", 5, "orphan"), ("2", 1, "orphan")])
    assert json.loads(next(r.json for r in rows if r.status == "linked"))["result"] == "r1"


@pytest.mark.parametrize(
    "args,errors",
    [
        ('{"a":1}', []), ('{"b":true}', ["a: missing"]), ('{"a":"1"}', ["a: not of type integer"]), ('{"a":10}', ["a: maximum"]), ('{"a":-1}', ["a: minimum"]), ('{"a":1,"s":"x"}', ["s: minLength"]),
        ('{"a":1,"s":"xxxx"}', ["s: maxLength"]), ('{"a":1,"e":"z"}', ["e: enum"]), ('{"a":1,"q":1,"p":2}', ["not allowed: p,q"]), ('{"a":1,"o":{},"n":1.5,"l":[1],"b":false,"s":"é€"}', []), ('{"a":1,"o":[]}', ["o: not of type object"]),
        ("[1]", ["arguments: not an object"]), ("{", ["arguments: not an object"]), (None, ["arguments: not an object"]),
    ],
)
def test_schema(spark, args, errors):
    (row,) = linked(spark, [call(1, 0, "a", args)], [])
    assert json.loads(row.json)["errors"] == errors and row.valid == (not errors)


def test_canonical_json(spark):
    text = 'q"b\\s/\n\t\u0001é\U0001f600'
    (row,) = linked(spark, [call(1, 0, "a", '{ "s":"xy", "a":1 }')], [(1, 1, "a", text)])
    assert row.json.startswith('{"arguments":{"a":1,"s":"xy"},"errors":[],"id":"a","name":"add","result":"q\\"b')
    assert json.loads(row.json)["result"] == text and list(json.loads(row.json)) == sorted(json.loads(row.json))


def test_topological_order(spark):
    calls = [call(1, 0, "c", after=["a", "b"]), call(1, 1, "a"), call(1, 2, "b", after=["a"]), call(1, 3, "d", after=["c", "gone"]), call(2, 0, "x", after=["y"]), call(2, 1, "y", after=["x"]), call(2, 2, "z", after=["y"]), call(2, 3, "w"), call(3, 0, "s", after=["s"]), call(4, 5, "k", after=["j"]), call(4, 4, "j", after=[])]
    rows = linked(spark, calls, [])
    level = {r.call_id: r.level for r in rows}
    assert level == {"a": 0, "b": 1, "c": 2, "d": 3, "x": -1, "y": -1, "z": -1, "w": 0, "s": -1, "j": 0, "k": 1}


@pytest.mark.parametrize("in_row", [256, 3])
@pytest.mark.parametrize("seed", range(2))
def test_levels_against_brute_force(spark, monkeypatch, in_row, seed):
    monkeypatch.setattr(C, "IN_ROW", in_row)
    rng = random.Random(seed)
    calls = [call(1, 40 - i, f"r{i}", after=[f"r{i - 1}"] if i else []) for i in range(40)]  # a chain, back to front
    calls += [call(2, i, f"c{i}", after=[f"c{(i + 1) % 7}"]) for i in range(7)] + [call(2, 9, "behind", after=["c3", "free"]), call(2, 10, "free")]
    for conv in range(3, 25):
        n = rng.randrange(1, 10)
        calls += [call(conv, i, f"{i}", after=[str(rng.randrange(n + 1)) for _ in range(rng.randrange(0, 3)) if rng.random() < 0.6]) for i in range(n)]
    calls += calls[:5]  # repeated rows

    def level(conv, name, needs, above=()):
        if name in above:
            return -1
        found = [level(conv, x, needs, (*above, name)) for x in needs[conv, name] if (conv, x) in needs]
        return -1 if -1 in found else max(found, default=-1) + 1

    needs = {(c[0], c[3]): c[6] for c in calls}
    got = {(r.conv_id, r.call_id): r.level for r in linked(spark, calls, []) if r.status != "repeated"}
    assert got == {k: level(*k, needs) for k in needs}


def levels(spark, calls):
    df = spark.createDataFrame(calls, C.CALLS)
    return {(r.conv_id, r.call_id): r.level for r in C.call_levels(df, df.select("conv_id", "call_id", "turn", "place")).collect()}


def test_forward_needs_take_one_pass(spark):
    for n in (8, 256):  # the first compiles
        calls = [call(c, i, f"{i:03d}", after=[f"{j:03d}" for j in range(i + 1, n)]) for c in range(4) for i in range(n)]
        began = time.perf_counter()
        got = levels(spark, calls)
        took = time.perf_counter() - began
    assert got == {(c, f"{i:03d}"): 255 - i for c in range(4) for i in range(256)}
    assert took < 12


def test_long_conversations_take_few_rounds(spark, monkeypatch):
    rounds, real = [], C.settled
    monkeypatch.setattr(C, "settled", lambda *a: rounds.append(1) or real(*a))
    calls = [call(1, i, f"{i}", after=[f"{i - 1}", f"{i - 2}"]) for i in range(1000)]
    assert levels(spark, calls) == {(1, f"{i}"): i for i in range(1000)}
    assert len(rounds) <= 1 + 2 * -(-1000 // C.IN_ROW) + 4  # ranges cut rows in two


@pytest.mark.parametrize("in_row", [256, 2])
def test_call_order_against_sql(spark, monkeypatch, in_row, tiny):
    monkeypatch.setattr(C, "IN_ROW", in_row)
    assert_same(C.call_order(spark, tiny), C.CALL_ORDER, tiny)
    assert {r.level for r in C.call_order(spark, tiny).collect()} >= {-1, 0, 1, 2}


def test_no_python_in_the_plan(spark, tiny):
    plan = C.op3(spark, tiny)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_very_long_text_and_more_columns(spark):
    text = "x\n" * 500_000
    calls = spark.createDataFrame([(*call(1, 0, "a"), "s", 1)], C.CALLS + ", status string, level int")
    results = spark.createDataFrame([(1, 1, "a", text, "j")], C.RESULTS + ", json string")
    (row,) = C.link_calls(calls, results, TOOLS).collect()
    assert row.status == "linked" and json.loads(row.json)["result"] == text


@pytest.mark.parametrize("texts", [("100", "1e2", "100.0", "1.0E2"), ("1.5", "15e-1", "1.50"), ("12345678.5", "1.23456785e7"), ("0.0000001", "1e-7"), ("99999999999999999999", "99999999999999999999.0"), ("0", "-0.0", "0e5"), ("1e300", "10e299")])
def test_one_form_for_each_number(spark, texts):
    rows = linked(spark, [call(1, i, str(i), '{"a":1,"n":%s,"l":["1e2",{"x":[%s]}]}' % (x, x)) for i, x in enumerate(texts)], [])
    assert len({r.json.split(',"id"')[0] for r in rows}) == 1 and '"1e2"' in rows[0].json and all(r.valid for r in rows)


def test_enum_and_integers_by_value(spark):
    tools = {"add": {"properties": {"e": {"enum": [True, 1, "1", None, {"k": [1.5]}]}, "i": {"type": "integer"}}}}
    good = ['{"e":true}', '{"e":1.0}', '{"e":"1"}', '{"e":{ "k":[15e-1]}}', '{"i":99999999999999999999}', '{"i":1e2}', '{"i":1.0}']
    bad = ['{"e":"true"}', '{"e":"True"}', '{"e":false}', '{"e":2}', '{"e":{"k":[1]}}', '{"i":1.5}', '{"i":"1"}', '{"i":true}']
    rows = linked(spark, [call(1, i, str(i), x) for i, x in enumerate(good + bad)], [], tools)
    assert [r.valid for r in sorted(rows, key=lambda r: r.turn)] == [True] * len(good) + [False] * len(bad)


def test_transcripts_and_unknown_tool(spark):
    said = json.dumps({"tool_calls": [{"id": "1", "name": "add", "arguments": {"a": 3}, "after": []}, {"id": "2", "name": "no", "arguments": {}}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (1, 2, "tool", json.dumps({"tool_call_id": "1", "content": "3"})), (1, 3, "assistant", "plain"), (1, 4, None, None)]
    calls, results = C.read_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.call_id: (r.status, r.valid) for r in C.link_calls(calls, results, TOOLS).collect()}
    assert got == {"1": ("linked", True), "2": ("unanswered", False)}


def test_empty(spark):
    assert linked(spark, [], []) == []

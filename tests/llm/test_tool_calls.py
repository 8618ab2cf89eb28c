import json

from veriscope.llm import tool_calls as tc

CALLS = "conv_id string, turn int, call_id string, name string, arguments string, depends array<string>, status string"
SCHEMAS = [("f", json.dumps({"properties": {"a": {"type": "integer"}}, "required": ["a"], "additionalProperties": False}))]


def run(spark, messages, calls, results):
    return tc.link_tool_calls(
        spark.createDataFrame(messages, "conv_id string, turn int, role string, content string"),
        spark.createDataFrame([(*c, "x") for c in calls], CALLS),
        spark.createDataFrame(results, "conv_id string, turn int, call_id string, content string"),
        spark.createDataFrame(SCHEMAS, "name string, schema string"),
    ).orderBy("conv_id", "position").collect()


def test_topological_order_and_links(spark):
    calls = [
        ("c", 1, "x", "f", '{"a": 1}', ["z"]), ("c", 1, "y", "f", '{"a": 2}', ["x"]), ("c", 1, "z", "f", '{"a":3}', []),
        ("c", 2, "late", "f", '{"a":4}', None), ("c", 0, "early", "f", '{"a":5}', ["late"]),
    ]
    results = [("c", 1, i, i) for i in ("x", "y", "z")] + [("c", 2, "late", "1"), ("c", 3, "early", "2")]
    got = run(spark, [("c", 0, "user", "hi")], calls, results)
    assert [(r.kind, r.call_id) for r in got] == [
        ("message", None), ("call", "z"), ("result", "z"), ("call", "x"), ("result", "x"), ("call", "y"), ("result", "y"),
        ("call", "late"), ("result", "late"), ("call", "early"), ("result", "early"),
    ]
    assert [r.position for r in got] == list(range(1, 12)) and all(r.status == "ok" for r in got)
    assert got[1].json == '{"arguments":{"a":3},"id":"z","name":"f","type":"tool_call"}'


def test_statuses(spark):
    calls = [
        ("c", 1, "p", "f", '{"a":1}', ["q"]), ("c", 1, "q", "f", '{"a":1}', ["p"]), ("c", 2, "d", "f", '{"a":1}', ["d", "none"]),
        ("c", 3, "d", "f", '{"a":1}', []), ("c", 4, "u", "f", '{"b":"x"}', []), ("c", 5, "n", "g", "no json", []), (None, 1, None, None, None, None),
    ]
    results = [("c", 3, "d", "one"), ("c", 4, "d", None), ("c", 9, "lost", "é\n"), ("c", 4, "u", "r")]
    got = run(spark, [], calls, results)
    assert {(r.kind, r.call_id, r.status) for r in got} == {
        ("call", "p", "cycle"), ("call", "q", "cycle"), ("call", "d", "ok"), ("call", "d", "duplicate"),
        ("call", "u", "invalid: missing a; unexpected b"), ("call", "n", "invalid: unknown function"), ("call", "", "invalid: unknown function"),
        ("result", "d", "ok"), ("result", "d", "duplicate"), ("result", "lost", "orphan"), ("result", "u", "ok"),
    }
    assert '{"content":"é\\n","id":"lost","type":"tool_result"}' in [r.json for r in got]


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []


def test_nothing_that_models_write_stops_the_job(spark):
    deep = "[" * 200_000 + "]" * 200_000
    schemas = {
        "list": "[1]", "broken": "{", "odd type": '{"type": "date"}', "no dict": '{"properties": 3, "required": "a", "type": "object"}',
        "nullable": '{"properties": {"a": {"type": ["integer", "null"]}}}', "deep": '{"items": ' * 5000 + "true" + "}" * 5000,
    }
    cases = {
        ("list", "{}"): "invalid: schema is not an object", ("broken", "{}"): "invalid: schema is not an object",
        ("odd type", "{}"): "invalid: arguments: schema has an unknown type", ("no dict", '{"x": 1}'): "unanswered",
        ("nullable", '{"a": null}'): "unanswered", ("nullable", '{"a": 1.0}'): "unanswered", ("nullable", '{"a": 1.5}'): "invalid: a is not integer or null",
        ("nullable", f'{{"a": {deep}}}'): "invalid: nested too deep", ("nullable", '{"a": NaN}'): "invalid: arguments are not an object",
        ("nullable", '{"a": 1e999}'): "invalid: arguments are not an object", ("nullable", '{"b": "\\ud800"}'): "unanswered",
        ("nullable", None): "invalid: arguments are not an object", ("nullable", ""): "invalid: arguments are not an object",
        ("deep", "{}"): "invalid: schema is not an object", ("nullable", "9" * 5000): "invalid: arguments are not an object",
    }
    calls = [("c", i, str(i), name, text, []) for i, (name, text) in enumerate(cases)]
    got = tc.link_tool_calls(
        spark.createDataFrame([], "conv_id string, turn int, role string, content string"),
        spark.createDataFrame([(*c, "x") for c in calls], CALLS),
        spark.createDataFrame([], "conv_id string, turn int, call_id string, content string"),
        spark.createDataFrame([*schemas.items(), ("nullable", "~ the second of its name"), (None, "{}")], "name string, schema string"),
    ).collect()
    assert {int(r.call_id): r.status for r in got} == dict(enumerate(cases.values())) and len(got) == len(cases)
    by_id = {r.call_id: r.json for r in got}
    assert '"b":"\ufffd"' in by_id["10"] and deep in json.loads(by_id["7"])["arguments"]


def test_schemas_are_followed_at_any_depth():
    schema = {
        "type": "object", "required": ["kind", "points"], "additionalProperties": {"type": "string"},
        "properties": {
            "kind": {"enum": ["line", "area", None]},
            "points": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "number"}}, "required": ["x"], "additionalProperties": False}},
        },
    }
    good = {"kind": None, "points": [{"x": 1}, {"x": 2.5}], "note": "n"}
    assert tc.validate(good, schema) == []
    bad = {"kind": "dot", "points": [{"x": "1"}, {"y": 1}, 3], "note": 4}
    assert tc.validate(bad, schema) == [
        "kind is none of the choices", "note is not string", "points[0].x is not number", "missing points[1].x", "unexpected points[1].y",
        "points[2] is not object",
    ]
    assert tc.validate(True, {"type": "integer"}) == ["arguments is not integer"] and tc.validate([1], {"items": 5}) == ["[0]: schema is not an object"]

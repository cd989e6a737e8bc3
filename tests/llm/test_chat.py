import json

from contrail.llm.tool_calls import link_tool_calls

SCHEMA = "conv_id long, turn long, role string, text string"
SCHEMAS = [
    {"name": "add", "parameters": {
        "properties": {"x": {"type": "integer", "minimum": 0, "maximum": 9}, "y": {"type": "number"}, "how": {"type": "string", "enum": ["a", "b"]},
                       "list": {"type": "array"}, "map": {"type": "object"}, "on": {"type": "boolean"}, "no": {"type": "null"}},
        "required": ["x"], "additionalProperties": False}},
    {"name": "any", "parameters": {}},
]


def call(*calls):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), c)) for c in calls]})


def result(id_, content="ok"):
    return json.dumps({"tool_call_id": id_, "content": content})


def rows_of(frame, rows):
    got = link_tool_calls(frame(rows, SCHEMA), SCHEMAS).collect()
    return {(r.conv_id, r.turn, r.k): r for r in got}, len(got)


def test_links_and_plain_messages(frame):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("c1", "any", {}), ("c2", "any", {}))), (1, 2, "tool", result("c2", {"b": 1, "a": [1.50]})),
        (1, 3, "tool", result("c2")), (1, 4, "tool", result("zz")), (1, 5, "assistant", call(("c2", "any", {}))), (1, 6, "assistant", "plain {"),
        (1, 7, None, None), (1, 8, "assistant", ""), (1, 9, "tool", "[1]"), (1, 10, "assistant", '{"tool_calls": []}'),
        (2, 1, "tool", result("c1")), (None, 1, "assistant", call(("c1", "any", {}))), (None, 2, "tool", result("c1")),
        (3, 0, "user", "x" * 200_000),
    ]
    got, n = rows_of(frame, rows)
    assert n == len(rows) + 1
    status = {k: r.status for k, r in got.items()}
    assert status[1, 1, 0] == "unanswered" and status[1, 1, 1] == "linked" and status[1, 2, 0] == "linked"
    assert status[1, 3, 0] == "repeated" and status[1, 4, 0] == "orphan" and status[1, 5, 0] == "repeated"
    assert {status[1, t, 0] for t in (0, 6, 7, 8, 9, 10)} == {"plain"} and status[2, 1, 0] == "orphan"
    assert status[None, 1, 0] == "linked" and status[None, 2, 0] == "linked"
    assert got[1, 2, 0].json == '{"content":{"a":[1.5],"b":1},"id":"c2","kind":"result","role":"tool"}'
    assert got[1, 0, 0].json == '{"kind":"message","role":"user","text":"hi"}'
    assert all((r.ready_turn, r.depth, r.cyclic) == (r.turn, 0, False) for r in got.values())


def test_order(frame):
    rows = [
        (1, 0, "tool", result("c1")), (1, 1, "assistant", call(("c2", "any", {}, ["c1"]))), (1, 2, "tool", result("c2")),
        (1, 3, "assistant", call(("c1", "any", {}))), (1, 4, "user", "bye"),
        (2, 0, "assistant", call(("a", "any", {}, ["b"]))), (2, 1, "assistant", call(("b", "any", {}, ["a"]))), (2, 2, "tool", result("b")),
        (2, 3, "assistant", call(("d", "any", {}, ["unknown"]))), (3, 0, "assistant", call(("s", "any", {}, ["s"]))),
        (4, 0, "assistant", call(("p", "any", {}), ("q", "any", {}, ["p"]))),
    ]
    got, _ = rows_of(frame, rows)
    place = lambda c: sorted((r.ready_turn, r.depth, r.turn) for k, r in got.items() if k[0] == c)
    assert [t for *_, t in place(1)] == [3, 0, 1, 2, 4]
    assert {k: r.cyclic for k, r in got.items() if k[0] in (2, 3)} == {
        (2, 0, 0): True, (2, 1, 0): True, (2, 2, 0): True, (2, 3, 0): False, (3, 0, 0): True}
    assert not got[4, 0, 1].cyclic


def test_validation(frame):
    cases = {
        '{"x":3,"y":1.5,"how":"a","list":[1],"map":{},"on":true,"no":null}': "",
        '{"x":10}': "range:x", '{"x":"3"}': "type:x", '{"y":1}': "missing:x", '{"x":1,"z":0}': "extra:z", '{"x":1,"how":"c"}': "enum:how",
        '{"x":1.5,"y":"q","list":{},"map":[],"on":1,"no":0}': "type:list,type:map,type:no,type:on,type:x,type:y", "[1]": "not_object",
        "{": "not_json", '{"x":1,"x":2}': "not_json",
    }
    rows = [(1, i, "assistant", call((f"c{i}", "add", a))) for i, a in enumerate(cases)]
    rows += [(1, 90, "assistant", call(("n", "nope", {}))), (1, 91, "assistant", call((None, "any", {"b": {"d": 1, "c": "é\n"}})))]
    got, _ = rows_of(frame, rows)
    assert [got[1, i, 0].errors for i in range(len(cases))] == list(cases.values())
    assert got[1, 90, 0].errors == "unknown_tool" and got[1, 91, 0].errors == "" and got[1, 91, 0].status == "unanswered"
    assert got[1, 91, 0].json == '{"arguments":{"b":{"c":"é\\n","d":1}},"kind":"call","name":"any","role":"assistant"}'


def test_repeated_rows_and_empty_table(frame):
    rows = [(1, 0, "assistant", call(("c", "any", {})))] * 2 + [(1, 1, "tool", result("c"))] * 2
    got = link_tool_calls(frame(rows, SCHEMA), SCHEMAS)
    assert sorted(r.status for r in got.collect()) == ["linked", "linked", "repeated", "repeated"]
    assert link_tool_calls(frame(rows, SCHEMA).filter("false"), SCHEMAS).count() == 0

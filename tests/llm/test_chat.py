"""Tool calls: linking, order, validation, canonical form, odd rows."""

import json
import random

from lantern.llm import chat

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer", "minimum": 0}}, "required": ["a"], "additionalProperties": False}, "say": {"type": "object"}}


def calls(*items):
    return json.dumps({"content": "x", "tool_calls": [{"id": i, "type": "function", "function": {"name": n, "arguments": a}} for i, n, a in items]})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows, schemas=SCHEMAS):
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, json string")
    return sorted(chat.format_chats(frame, schemas).collect(), key=lambda r: (str(r.conv_id), r.position))


def test_links_order_and_validity(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", result("c1")),  # before its call
        (1, 2, "assistant", calls(("c1", "add", {"b": 1, "a": 2}), ("c2", "add", {"a": "x"}))),
        (1, 3, "assistant", 'thinking <tool_call>{"id": "c3", "name": "say", "arguments": {"text": "c4"}}</tool_call>'),
        (1, 4, "assistant", calls(("c4", "other", {}))),
        (1, 5, "tool", result("nobody")),
    ]
    out = run(spark, rows)
    assert [r.turn for r in out] == [0, 2, 1, 4, 3, 5]  # c3 names c4
    by = {r.turn: r for r in out}
    assert (by[2].n_calls, by[2].n_valid, by[2].n_linked) == (2, 1, 1)
    assert (by[1].n_results, by[1].n_linked) == (1, 1) and (by[5].n_results, by[5].n_linked) == (1, 0)
    assert by[3].n_valid == 1 and by[4].n_valid == 0
    assert by[2].json == '{"content":"x","role":"assistant","tool_calls":[{"function":{"arguments":{"a":2,"b":1},"name":"add"},"id":"c1","type":"function"},{"function":{"arguments":{"a":"x"},"name":"add"},"id":"c2","type":"function"}]}'
    assert [r.position for r in out] == list(range(6))


def test_schemas_come_from_the_conversations(spark):
    tool = lambda name, schema: {"type": "function", "function": {"name": name, "parameters": schema}}
    strict, loose = SCHEMAS["add"], {"type": "object"}
    defined = {1: {"add": strict}, 2: {"add": loose}, 3: {"add": strict, "bad": {"pattern": "(", "minimum": "x", "required": 3}}}
    rows = [(c, 0, "system", json.dumps({"tools": [tool(n, s) for n, s in tools.items()]})) for c, tools in defined.items() if c < 3]
    rows.append((3, 0, "system", "Use <tools>" + "\n".join(json.dumps(tool(n, s)) for n, s in defined[3].items()) + "</tools>"))
    told = {}
    for c in (1, 2, 3, 4):  # conversation 4 defines nothing: the most common definition counts
        asked = [("a", "add", {"a": 1}), ("b", "add", {"a": "x"}), ("c", "add", {}), ("d", "add", {"a": 1}), ("e", "bad", {"x": 1}), ("f", "none", {})]
        rows += [(c, 1, "assistant", calls(*asked)), (c, 2, "tool", result("a")), (c, 3, "tool", result("f"))]
        schemas = {"add": strict, **defined.get(c, {})}
        told[c] = sum(n in schemas and chat.conforms(a, schemas[n]) for _, n, a in asked)
    out = run(spark, rows, None)
    assert {r.conv_id: r.n_valid for r in out if r.turn == 1} == told == {1: 2, 2: 4, 3: 2, 4: 2}
    assert all((r.n_calls, r.n_linked) == (6, 2) for r in out if r.turn == 1) and all(r.n_linked == 1 for r in out if r.role == "tool")


def test_a_malformed_call_spares_the_others():
    whole = json.dumps({"content": "x", "tool_calls": [{"id": "a", "name": "say", "arguments": {}}, {"name": "no id"}]})
    assert chat.parse_message("assistant", whole) == ('x\n{"tool_calls":[{"name":"no id"}]}', [{"id": "a", "name": "say", "arguments": {}}], [])
    marked = 'hm <tool_call>{broken</tool_call> <tool_call>{"id": "a", "name": "say"}</tool_call>'
    assert chat.parse_message("assistant", marked) == ("hm <tool_call>{broken</tool_call>", [{"id": "a", "name": "say", "arguments": {}}], [])


def test_cycles_and_chains(spark):
    rows = [(2, 0, "assistant", calls(("a", "say", {"x": "b"}))), (2, 1, "assistant", calls(("b", "say", {"x": "a"}))), (2, 2, "assistant", calls(("d", "say", {"x": ["e"]}))), (2, 3, "assistant", calls(("e", "say", {}))), (2, 4, "tool", result("d"))]
    out = run(spark, rows)
    assert {r.turn: r.in_cycle for r in out} == {0: True, 1: True, 2: False, 3: False, 4: False}
    places = {r.turn: r.position for r in out}
    assert places[3] < places[2] < places[4]


def test_a_call_waits_for_the_result_it_needs(spark):
    rows = [(1, 1, "assistant", calls(("b", "say", {}))), (1, 2, "assistant", calls(("a", "say", {"x": "b"}))), (1, 3, "tool", result("b")), (1, 4, "user", "so?"), (1, 5, "tool", result("a"))]
    # A message moves with all its calls, and the results of the others follow it.
    rows += [(2, 1, "assistant", calls(("a", "say", {"x": "b"}), ("c", "say", {}))), (2, 2, "tool", result("c")), (2, 3, "assistant", calls(("b", "say", {}))), (2, 4, "tool", result("b"))]
    # A call that names another one of its message does not move it.
    rows += [(3, 1, "assistant", calls(("a", "say", {"x": "b"}), ("b", "say", {}))), (3, 2, "tool", result("b"))]
    out = run(spark, rows)
    assert [[r.turn for r in out if r.conv_id == c] for c in (1, 2, 3)] == [[1, 3, 2, 4, 5], [3, 4, 1, 2], [1, 2]]
    assert not any(r.in_cycle for r in out)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, names = 60, []
    staged = chat.shared.staged
    monkeypatch.setattr(chat.shared, "staged", lambda df, name: (names.append(name), staged(df, name))[1])
    rows = [(1, t, "assistant", calls((f"c{t}", "say", {"x": f"c{t + 1}"}))) for t in range(n)] + [(1, n, "tool", result("c0"))]
    assert [r.turn for r in run(spark, rows)] == [*range(n - 1, -1, -1), n]
    assert names.count("chat-paths") <= 10


def test_order_against_plain_search(spark):
    """Random needs and results in many conversations: every edge outside of cycles is kept, and cycles are told."""
    rng, rows, graphs = random.Random(1), [], {}
    for conv in range(60):
        told = [(rng.randrange(6), [rng.randrange(8) for _ in range(rng.randrange(3))], rng.randrange(8)) for _ in range(rng.randrange(1, 9))]
        names = [("c", i) for i in range(len(told))] + [("r", i) for i, (_, _, answer) in enumerate(told) if answer < 5]
        rows += [(conv, t, "assistant", calls((f"c{i}", "say", {"x": [f"c{k}" for k in needs]}))) for i, (t, needs, _) in enumerate(told)]
        rows += [(conv, told[i][2] * 4, "tool", result(f"c{i}")) for kind, i in names if kind == "r"]
        edges = {(("c", i), ("r", i)) for kind, i in names if kind == "r"}
        graphs[conv] = names, edges | {(("r", k) if ("r", k) in names else ("c", k), ("c", i)) for i, (_, needs, _) in enumerate(told) for k in needs if k != i and k < len(told)}
    out, n_looped = run(spark, rows), 0
    for conv, (names, edges) in graphs.items():
        above = {n: {u for u, v in edges if v == n} for n in names}
        for _ in names:
            above = {n: us.union(*(above[u] for u in us)) for n, us in above.items()}
        looped = {n for n in names if n in above[n] or any(u in above[u] for u in above[n])}
        place, told = {}, set()
        for r in (r for r in out if r.conv_id == conv):
            value = json.loads(r.json)
            name = ("c", int(value["tool_calls"][0]["id"][1:])) if r.n_calls else ("r", int(json.loads(value["content"])["tool_call_id"][1:]))
            place[name] = r.position
            told |= {name} if r.in_cycle else set()
        assert set(place) == set(names) and told == {n for n in looped if n[0] == "c"}
        assert all(place[u] < place[v] for u, v in edges if v not in looped)
        n_looped += bool(looped)
    assert 0 < n_looped < 60


def test_derived_messages_exercise_the_method(spark):
    out = chat.op7_chat(spark, "/root/testdata/sf0.01")
    told = out.selectExpr("sum(n_calls) c", "sum(n_valid) v", "sum(n_linked) l", "count_if(in_cycle) x", "count_if(role = 'user') u").first()
    assert 0 < told.v < told.c and told.l > 0 and told.x > 0 and told.u == 279


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (None, None, None, None), (3, 0, "assistant", '{"tool_calls": [1]}'), (3, 0, "assistant", '{"tool_calls": [1]}'), (3, 1, "tool", "not json"), (3, 2, "assistant", "<tool_call>{broken</tool_call>"), (3, 3, "user", "é" * 100_000)]
    out = run(spark, rows)
    assert len(out) == len(rows) and all(r.n_calls == r.n_linked == 0 for r in out)
    assert [r.position for r in out if r.conv_id == 3] == [0, 1, 2, 3, 4]
    assert [r.turn for r in out if r.conv_id is None] == [None, 1]
    assert run(spark, []) == []


def test_long_conversation_is_numbered_across_chunks(spark):
    rows = [(7, t, "user", str(t)) for t in range(2500)]
    assert [r.turn for r in run(spark, rows)] == list(range(2500))


def test_canonical_and_schema():
    assert chat.canonical({"b": [1.5, None], "a": "é\n"}) == '{"a":"é\\n","b":[1.5,null]}'
    assert chat._load('{"a": 1, "a": 2}') is None and chat._load("NaN") is None
    assert chat.violations({"a": 1.0, "b": -1, "c": 0}, SCHEMAS["add"]) == ["/b: range", "/c: unknown"]
    assert chat.violations({}, SCHEMAS["add"]) == ["/a: required"] and chat.violations([], SCHEMAS["add"]) == ["/: type"]

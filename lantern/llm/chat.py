"""Chat formatting: tool calls linked with their results, ordered, validated, as canonical JSON.

A call is found in an assistant's message, as `{"tool_calls": [...]}` that is the whole text or in
`<tool_call>` marks; a result is a tool's message with a `tool_call_id`, as a whole or in
`<tool_response>` marks. Calls and results meet in a hash join on conversation and identifier. A
call that names another call's identifier among its arguments depends on it. Messages keep their
turns, except that a result comes after its call, and a call after the result that it needs (after
the call itself where nothing answers it). Arguments are validated against the tool definitions in
the system messages, as `{"tools": [...]}` that is the whole text or in `<tools>` marks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.llm import arrow, shared

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_RESPONSE = re.compile(r"<tool_response>(.*?)</tool_response>", re.S)
_TOOLS = re.compile(r"<tools>(.*?)</tools>", re.S)
_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: Turns of one conversation that one window orders.
TURNS = 1024


def canonical(value: Any) -> str:
    """JSON with sorted keys and no white space; one text for equal values."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _load(text: str | None) -> Any:
    """The JSON value of a text, or None; numbers outside JSON and repeated keys aren't accepted."""

    def pairs(items: list[tuple[str, Any]]) -> dict:
        if len(dict(items)) < len(items):
            raise ValueError("a key comes twice")
        return dict(items)

    def constant(name: str) -> Any:
        raise ValueError(f"{name} is no JSON")

    try:
        value = json.loads(text or "", object_pairs_hook=pairs, parse_constant=constant)
        canonical(value)
        return value
    except (ValueError, RecursionError):
        return None


def _call(value: Any) -> dict | None:
    if not isinstance(value, dict):
        return None
    inner = value.get("function") if isinstance(value.get("function"), dict) else value
    arguments = inner.get("arguments", {})
    if isinstance(arguments, str):
        arguments = _load(arguments)
    if not isinstance(value.get("id"), str) or not isinstance(inner.get("name"), str):
        return None
    return {"id": value["id"], "name": inner["name"], "arguments": arguments}


def parse_message(role: str | None, text: str | None) -> tuple[str, list[dict], list[str]]:
    """(content, calls, identifiers of results) of a message."""
    text = text or ""
    if role == "assistant" and ("tool_call" in text):
        whole = _load(text) if text.lstrip()[:1] == "{" else None
        if isinstance(whole, dict) and isinstance(whole.get("tool_calls"), list):
            calls = [_call(c) for c in whole["tool_calls"]]
            if any(calls):
                other = [c for c, call in zip(whole["tool_calls"], calls) if not call]
                content = [str(whole.get("content") or ""), canonical({"tool_calls": other}) if other else ""]
                return "\n".join(c for c in content if c), [c for c in calls if c], []
        calls = [c for c in (_call(_load(m)) for m in _CALL.findall(text)) if c]
        if calls:
            return _CALL.sub(lambda m: "" if _call(_load(m[1])) else m[0], text).strip(), calls, []
    if role == "tool":
        found = [_load(m) for m in _RESPONSE.findall(text)] or [_load(text)]
        ids = [r["tool_call_id"] for r in found if isinstance(r, dict) and isinstance(r.get("tool_call_id"), str)]
        return text, [], ids
    return text, [], []


def tools_of(role: str | None, text: str | None) -> list[dict]:
    """(name, schema) of the tools that a system message defines, the schema as canonical JSON."""
    if role != "system" or "tools" not in (text or ""):
        return []
    values: list[Any] = [v["tools"]] if isinstance(v := _load(text), dict) and "tools" in v else []
    for inner in _TOOLS.findall(text):
        values += [_load(inner)] if _load(inner) is not None else [_load(line) for line in inner.splitlines()]
    found = []
    for tool in (t for v in values for t in (v if isinstance(v, list) else [v])):
        tool = tool["function"] if isinstance(tool, dict) and isinstance(tool.get("function"), dict) else tool
        if isinstance(tool, dict) and isinstance(tool.get("name"), str):
            schema = tool.get("parameters", tool.get("input_schema", {}))
            if isinstance(schema, dict):
                found.append({"name": tool["name"], "schema": canonical(schema)})
    return found


def conforms(value: Any, schema: dict) -> bool:
    """Whether a value keeps to a schema from the data; to one that can't be applied, none does."""
    try:
        return not violations(value, schema)
    except (TypeError, ValueError, AttributeError, re.error, RecursionError):
        return False


def violations(value: Any, schema: dict, at: str = "") -> list[str]:
    """Where a value breaks a JSON schema: type, enum, bounds, required, properties, items."""
    found: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        fits = {"number": number, "integer": number and float(value).is_integer()}
        if not any(fits.get(k, isinstance(value, _TYPES.get(k, ()))) for k in kinds):
            return [f"{at or '/'}: type"]
    if "enum" in schema and canonical(value) not in {canonical(v) for v in schema["enum"]}:
        found.append(f"{at or '/'}: enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{at or '/'}: range")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            found.append(f"{at or '/'}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at or '/'}: pattern")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, item in enumerate(value):
            found += violations(item, schema["items"], f"{at}/{i}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}/{k}: required" for k in schema.get("required", []) if k not in value]
        for key, item in value.items():
            if key in known:
                found += violations(item, known[key], f"{at}/{key}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}/{key}: unknown")
    return found


def _strings(value: Any) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, (list, dict)):
        for item in value.values() if isinstance(value, dict) else value:
            yield from _strings(item)


def parsed(conversations: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row a message: its place, its canonical JSON, its calls and the results it holds."""

    def call(c: dict) -> dict:
        valid = c["name"] in schemas and conforms(c["arguments"], schemas[c["name"]])
        return {"id": c["id"], "name": c["name"], "arguments": canonical(c["arguments"]), "valid": valid, "needs": sorted(set(_strings(c["arguments"])) - {c["id"]})}

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            content, calls, results = parse_message(row["role"], row["text"])
            message = {"content": content, "role": row["role"]}
            if calls:
                message["tool_calls"] = [{"function": {"arguments": c["arguments"], "name": c["name"]}, "id": c["id"], "type": "function"} for c in calls]
            yield {
                "conv_id": row["conv_id"],
                "turn": row["turn"],
                "role": row["role"],
                "json": canonical(message),
                "calls": [call(c) for c in calls],
                "results": sorted(set(results)),
                "tools": tools_of(row["role"], row["text"]),
            }

    ddl = "role string, json string, calls array<struct<id:string,name:string,arguments:string,valid:boolean,needs:array<string>>>, results array<string>, tools array<struct<name:string,schema:string>>"
    schema = arrow.schema(conversations.schema["conv_id"], conversations.schema["turn"], ddl)
    return arrow.map_rows(conversations.select("conv_id", "turn", "role", "text"), run, schema, rows=1024)


def _valid_calls(rows: DataFrame) -> DataFrame:
    """(conv, message, n_valid): the calls of a message that keep to the definition of their tool.

    A conversation's own definition counts, the least of several; without one, that which most
    messages hold. Calls of tools that nothing defines are not valid.
    """
    tools = shared.staged(rows.filter(F.size("tools") > 0).select("conv", F.explode("tools").alias("t")).select("conv", "t.name", "t.schema"), "chat-tools")
    own = tools.groupBy("conv", "name").agg(F.min("schema").alias("_own"))
    common = tools.groupBy("name", "schema").agg(F.count(F.lit(1)).alias("n"))
    common = shared.staged(common.groupBy("name").agg(F.min(F.struct(-F.col("n"), "schema")).alias("_c")).select("name", F.col("_c.schema").alias("_common")), "chat-tools")
    calls = rows.filter(F.size("calls") > 0).select("conv", "message", "calls").dropDuplicates(["conv", "message"])
    calls = calls.select("conv", "message", F.explode("calls").alias("c")).select("conv", "message", "c.name", "c.arguments")
    calls = calls.join(own, ["conv", "name"], "left").join(shared.small(common), "name", "left")
    calls = calls.select("conv", "message", "arguments", F.coalesce("_own", "_common").alias("schema")).filter("schema is not null")

    def run(found: Iterator[dict]) -> Iterable[dict]:
        for row in found:
            if conforms(json.loads(row["arguments"]), json.loads(row["schema"])):
                yield {"conv": row["conv"], "message": row["message"]}

    return arrow.map_rows(calls, run, "conv string, message long", rows=1024).groupBy("conv", "message").agg(F.count(F.lit(1)).cast("int").alias("n_valid"))


def ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, message, place, depth, cycle) of `nodes` (conv, message, turn) that `edges` (conv, u, v) put in order.

    `place` is the last turn among a message and all that it must follow, `depth` the length of the
    longest path to it: sorting by both keeps every edge. Messages on a cycle, or after one, keep
    their turn and depth 0. Paths double in length from round to round, so a chain of n messages
    takes log n rounds; a round holds the pairs at exactly that distance, not all that are reachable.
    """
    told = shared.staged(nodes.select("conv", "message", F.col("turn").alias("place"), F.lit(0).cast("long").alias("depth")), "chat-order")
    paths, length = shared.staged(edges.select("conv", "u", "v").filter("u <> v").distinct(), "chat-paths"), 1
    longest = paths.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while length <= longest and not paths.isEmpty():
        reached = paths.join(told.withColumnRenamed("message", "u"), ["conv", "u"])
        reached = reached.groupBy("conv", F.col("v").alias("message")).agg(F.max("place").alias("_place"), (F.max("depth") + length).alias("_depth"))
        told = told.join(reached, ["conv", "message"], "left")
        told = shared.staged(told.select("conv", "message", F.greatest("place", "_place").alias("place"), F.greatest("depth", "_depth").alias("depth")), "chat-order")
        onward = paths.select("conv", F.col("u").alias("v"), F.col("v").alias("w"))
        paths = shared.staged(paths.join(onward, ["conv", "v"]).select("conv", "u", F.col("w").alias("v")).distinct(), "chat-paths")
        length *= 2
    # A path with more edges than there are comes from a cycle.
    endless = paths.select("conv", F.col("v").alias("message")).distinct().withColumn("cycle", F.lit(True))
    told = told.join(endless, ["conv", "message"], "left").join(nodes.select("conv", "message", "turn"), ["conv", "message"])
    cycle = F.coalesce("cycle", F.lit(False))
    return told.select("conv", "message", F.when(cycle, F.col("turn")).otherwise(F.col("place")).alias("place"), F.when(cycle, 0).otherwise(F.col("depth")).alias("depth"), cycle.alias("cycle"))


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Every row of `conversations` (conv_id, turn, role, text; others are ignored) as a canonical message.

    `schemas` has the JSON schema of each tool's arguments by its name; calls of other tools are not
    valid. Without it, the tool definitions in the system messages count. Returns conv_id, turn,
    position (gapless from 0 within the conversation), role, json, n_calls, n_valid, n_results,
    n_linked (calls with a result, or results with a call), in_cycle.

    Null texts are empty; a null conv_id is a conversation of its own, a null turn comes first.
    Rows that share a turn are ordered by role and content. Of several calls that share an
    identifier the first counts, and a call waits for the first result of several. A need within
    one message doesn't move it. What can't be read as a call is content. Repeated rows stand side
    by side. An empty table gives an empty result.
    """
    conv = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = parsed(conversations, schemas or {}).withColumn("conv", conv).withColumn("_turn", F.coalesce("turn", F.lit(-1)).cast("long"))
    rows = shared.staged(rows.withColumn("message", F.xxhash64("_turn", "role", "json")), "chat-rows")
    busy = rows.filter((F.size("calls") > 0) | (F.size("results") > 0))

    first = lambda *more: F.min(F.struct("_turn", "message", *more)).alias("f")
    held = busy.select("conv", "_turn", "message", F.explode("calls").alias("c")).select("conv", "_turn", "message", "c.id", "c.needs")
    calls = shared.staged(held.groupBy("conv", "id").agg(first("needs")).select("conv", "id", F.col("f.message").alias("asked"), "f.needs"), "chat-calls")
    results = shared.staged(busy.select("conv", "_turn", "message", F.explode("results").alias("id")).distinct(), "chat-results")
    answers = results.groupBy("conv", "id").agg(first()).select("conv", "id", F.col("f.message").alias("answered"))
    linked = shared.staged(calls.join(answers.hint("shuffle_hash"), ["conv", "id"], "left"), "chat-linked")

    follows = results.join(linked.select("conv", "id", "asked"), ["conv", "id"]).select("conv", F.col("asked").alias("u"), F.col("message").alias("v"))
    needed = linked.select("conv", F.col("id").alias("need"), F.coalesce("answered", "asked").alias("u"), F.col("asked").alias("_asked"))
    waits = calls.select("conv", F.explode("needs").alias("need"), F.col("asked").alias("v")).join(needed, ["conv", "need"]).filter("_asked <> v").select("conv", "u", "v")
    nodes = shared.staged(busy.select("conv", "message", F.col("_turn").alias("turn")).distinct(), "chat-nodes")
    order = ordered(nodes, follows.union(waits))

    met = held.select("conv", "message", "id").distinct().join(linked.filter("answered is not null").select("conv", "id"), ["conv", "id"])
    met = met.unionByName(results.select("conv", "message", "id").join(linked.select("conv", "id"), ["conv", "id"]))
    met = met.groupBy("conv", "message").agg(F.count(F.lit(1)).cast("int").alias("n_linked"))
    facts = order.join(met, ["conv", "message"], "left")
    if schemas is None:
        facts = facts.join(_valid_calls(rows), ["conv", "message"], "left")
    else:
        facts = facts.withColumn("n_valid", F.lit(None).cast("int"))
    facts = shared.staged(facts, "chat-facts")
    n_valid = F.coalesce("n_valid", F.lit(0)) if schemas is None else F.size(F.filter("calls", lambda c: c["valid"]))
    whole = rows.drop("tools").join(facts, ["conv", "message"], "left")
    whole = whole.withColumn("n_valid", n_valid).withColumn("place", F.coalesce("place", "_turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    # Chunks of turns keep long conversations apart.
    whole = shared.staged(whole.withColumn("_late", F.size("results") > 0), "chat-told")
    placed = shared.running_sum(whole, "conv", F.floor(F.col("place") / TURNS), ["place", "depth", "_late", "_turn", "role", "json"], F.lit(1), "position")
    return placed.select(
        "conv_id", "turn", F.col("position").cast("long").alias("position"), "role", "json",
        F.size("calls").alias("n_calls"), "n_valid", F.size("results").alias("n_results"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), ((F.size("calls") > 0) & F.coalesce("cycle", F.lit(False))).alias("in_cycle"),
    )


_MEASURE = '{"type":"object","properties":{"chars":{"type":"integer","maximum":%d}},"required":["chars"]}'
_TOOL_TEXT = '{"tools":[{"name":"measure","parameters":%s},{"name":"look","parameters":{"required":["chars"]}}]}'
#: The tool definitions that the derived messages hold: that of most conversations, and a stricter one.
DEFINED = (_TOOL_TEXT % (_MEASURE % 1000), _TOOL_TEXT % (_MEASURE % 200))


def with_tool_messages(conversations: DataFrame) -> DataFrame:
    """`conversations` and, beside its rows, tool messages derived from them by a fixed rule.

    The tables hold no tool calls; this gives the query something to link, order and validate. Every
    even conversation gets a system message with definitions (stricter ones where its number ends in
    4). Every assistant's turn gets a call with the message's length as argument, of the tool
    `look` at turns 3 modulo 4, `none` (undefined) at 7 modulo 8 and `measure` else, and a tool's
    result unless conversation and turn sum to 5 modulo 6. A call names the one before it. In
    conversations divisible by 5 it names the one after it, and in those 3 modulo 7, unless divisible
    by 5, it does so in a circle. The original rows are all kept.
    """
    c, t = F.col("conv_id"), F.col("turn")
    asked = conversations.filter((F.col("role") == "assistant") & c.isNotNull() & t.isNotNull())
    asked = asked.groupBy("conv_id", "turn").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("n"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    ends = asked.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    asked = asked.withColumn("_before", F.lag("turn").over(by_turn)).withColumn("_after", F.lead("turn").over(by_turn)).join(ends, "conv_id")
    need = F.when(c % 5 == 0, F.col("_after")).when(c % 7 == 3, F.coalesce("_after", "_first")).otherwise(F.col("_before"))
    name = F.when(t % 8 == 7, "none").when(t % 4 == 3, "look").otherwise("measure")
    call_id = lambda turn: F.concat(F.lit("call-"), c.cast("string"), F.lit("-"), turn.cast("string"))
    after = F.coalesce(F.concat(F.lit('"after":"'), call_id(need), F.lit('",')), F.lit(""))
    call = F.concat(F.lit('{"tool_calls":[{"id":"'), call_id(t), F.lit('","function":{"name":"'), name, F.lit('","arguments":{'), after, F.lit('"chars":'), F.col("n").cast("string"), F.lit("}}}]}"))
    result = F.concat(F.lit('{"tool_call_id":"'), call_id(t), F.lit('"}'))
    calls = asked.select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("text"))
    results = asked.filter((c + t) % 6 != 5).select("conv_id", "turn", F.lit("tool").alias("role"), result.alias("text"))
    first = conversations.filter(c % 2 == 0).groupBy("conv_id").agg(F.min("turn").alias("turn"))
    tools = first.select("conv_id", "turn", F.lit("system").alias("role"), F.when(c % 10 == 4, DEFINED[1]).otherwise(DEFINED[0]).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.unionByName(calls).unionByName(results).unionByName(tools)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(with_tool_messages(shared.table(spark, sf_dir, "conversations")))


def oracle() -> str:
    """DuckDB SQL for `op7_chat`: what the derived messages come to is told from their rule by windows."""
    return f"""
WITH a AS (
  SELECT conv_id AS c, turn AS t, coalesce(max(length(text)), 0) AS n FROM conversations
  WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), b AS (
  SELECT *, lag(t) OVER w AS before, lead(t) OVER w AS after, min(t) OVER (PARTITION BY c) AS t0, max(t) OVER (PARTITION BY c) AS t1,
    CASE WHEN t % 8 = 7 THEN 'none' WHEN t % 4 = 3 THEN 'look' ELSE 'measure' END AS name, ((c + t) % 6 <> 5)::INTEGER AS answered
  FROM a WINDOW w AS (PARTITION BY c ORDER BY t)
), k AS (
  SELECT *, CASE WHEN c % 5 = 0 THEN after WHEN c % 7 = 3 THEN coalesce(after, t0) ELSE before END AS need,
    c % 5 <> 0 AND c % 7 = 3 AND t0 <> t1 AS circle,
    coalesce(sum(1 + answered) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up,
    coalesce(sum(1 + answered) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS down,
    CASE name WHEN 'none' THEN 0 WHEN 'look' THEN 1 ELSE (n <= CASE WHEN c % 10 = 4 THEN 200 ELSE 1000 END)::INTEGER END AS valid
  FROM b
), o AS (
  SELECT *, 'call-' || c || '-' || t AS id, CASE WHEN c % 5 = 0 THEN t1 ELSE t END AS place,
    CASE WHEN circle THEN 0 WHEN c % 5 = 0 THEN down WHEN c % 7 = 3 THEN 0 ELSE up END AS depth FROM k
), m AS (
  SELECT conv_id, turn, role, coalesce(turn, -1) AS place, 0 AS depth, 0 AS late, json_object('content', coalesce(text, ''), 'role', role)::VARCHAR AS json,
    0 AS n_calls, 0 AS n_valid, 0 AS n_results, 0 AS n_linked, false AS in_cycle FROM conversations
  UNION ALL
  SELECT c, t, 'assistant', place, depth, 0, '{{"content":"","role":"assistant","tool_calls":[{{"function":{{"arguments":{{' || coalesce('"after":"call-' || c || '-' || need || '",', '')
    || '"chars":' || n || '}},"name":"' || name || '"}},"id":"' || id || '","type":"function"}}]}}', 1, valid, 0, answered, circle FROM o
  UNION ALL
  SELECT c, t, 'tool', place, CASE WHEN circle THEN 0 ELSE depth + 1 END, 1, json_object('content', '{{"tool_call_id":"' || id || '"}}', 'role', 'tool')::VARCHAR, 0, 0, 1, 1, false FROM o WHERE answered = 1
  UNION ALL
  SELECT conv_id, min(turn), 'system', coalesce(min(turn), -1), 0, 0, json_object('content', CASE WHEN conv_id % 10 = 4 THEN '{DEFINED[1]}' ELSE '{DEFINED[0]}' END, 'role', 'system')::VARCHAR, 0, 0, 0, 0, false
  FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id
)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY place, depth, late, coalesce(turn, -1), role, json) - 1 AS position, role, json,
  n_calls, n_valid, n_results, n_linked, in_cycle FROM m"""

"""Chat formatting with tool calls: link calls and results, order them, validate arguments, write canonical JSON.

Calls and results are narrow tables that a hash join links by (conv_id, call_id); what stays unlinked is reported.
Each conversation's calls are ordered topologically (Kahn's method; of the calls that may come next the one of the
earliest turn), arguments are checked against the called tool's schema, and the conversation is written as JSON with
sorted keys and no blanks.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.llm._shared import tune

#: The schema of the tool that the registered query sees in a conversation's turns.
SCHEMAS: dict[str, dict] = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks and characters as they are; NaN and infinities are not JSON and raise."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema the value violates: type, enum, const, required, properties, additionalProperties, items, and bounds."""
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        ok = False
        for k in [kinds] if isinstance(kinds, str) else kinds:
            if k in ("integer", "number"):
                ok |= isinstance(value, (int, float)) and not isinstance(value, bool) and (k == "number" or float(value).is_integer())
            else:
                ok |= isinstance(value, _TYPES[k])
        if not ok:
            return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: const")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in own:
                out += violations(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: additional")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(value[k], schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list):
        if "items" in schema:
            out += [v for i, x in enumerate(value) for v in violations(x, schema["items"], f"{at}[{i}]")]
        out += [f"{at}: {k}" for k, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", len(value)))) if bad]
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: {k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    return out


def topological(calls: list[tuple[str, int, list[str]]]) -> tuple[list[str], list[str]]:
    """(order, ids on or behind a cycle) of (id, turn, ids it comes after); unknown ids to come after don't count.

    Ties go to the smaller turn, then id.  Calls on or behind a cycle come last, in the order of turns.
    """
    turn = {i: t for i, t, _ in calls}
    needs = {i: {a for a in after if a in turn} for i, _, after in calls}
    behind: dict[str, list[str]] = {}
    for i, after in needs.items():
        for a in after:
            behind.setdefault(a, []).append(i)
    ready = [(turn[i], i) for i, after in needs.items() if not after]
    heapq.heapify(ready)
    left, order = {i: len(a) for i, a in needs.items()}, []
    while ready:
        _, i = heapq.heappop(ready)
        order.append(i)
        for j in behind.get(i, ()):
            left[j] -= 1
            if not left[j]:
                heapq.heappush(ready, (turn[j], j))
    stuck = sorted((i for i in turn if left[i]), key=lambda i: (turn[i], i))
    return order + stuck, stuck


def calls_of_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) that are written in messages.

    A call is an item of the ``tool_calls`` of an assistant message whose text is a JSON object: id, name, arguments and,
    if given, after.  A result is a message of the role tool whose text is an object with tool_call_id and content.
    """
    kind = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
    parsed = messages.where((F.col("role") == "assistant") & F.col("text").contains("tool_calls")).select("conv_id", "turn", F.inline(F.from_json("text", kind)["tool_calls"]))
    calls = parsed.where("id is not null").select("conv_id", F.col("id").alias("call_id"), "turn", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    result = F.from_json("text", "struct<tool_call_id:string,content:string>")
    results = messages.where((F.col("role") == "tool") & F.col("text").contains("tool_call_id")).select("conv_id", result["tool_call_id"].alias("call_id"), "turn", result["content"].alias("content"))
    return calls, results.where("call_id is not null")


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) that plain turns stand for: a user turn calls ``reply`` with its text, which the assistant's next turn answers.

    A call's id is c<conv_id>-<turn>; it comes after the user turn before it, however far back.  An assistant turn
    answers the user turn that it follows, system turns apart; one that follows no user turn is an orphan, named after
    the turn before its own.  Rows without a conv_id, turn or role take no part; of rows that repeat a turn the smallest
    role and text count; a null text is an empty prompt.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null and role is not null")
    turns = rows.groupBy("conv_id", "turn").agg(F.min(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    said = Window.partitionBy("conv_id").orderBy("turn")
    user = F.when(F.col("role") == "user", F.col("turn"))
    turns = turns.where("role in ('user', 'assistant')").withColumns({"before": F.last(user, True).over(said.rowsBetween(Window.unboundedPreceding, -1)), "asked": F.lag(user).over(said)})
    users = turns.where("role = 'user'")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    after = F.array_compact(F.array(name(F.col("before"))))
    calls = users.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", name(F.coalesce("asked", F.col("turn") - 1)).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def _write(schemas: dict[str, dict]):
    def one(conv_id: int, events: list[dict]) -> tuple:
        calls, orphans = [], []
        for e in events:
            (orphans if e["name"] is None and e["arguments"] is None and e["after"] is None else calls).append(e)
        order, stuck = topological([(c["call_id"], c["turn"], c["after"] or []) for c in calls])
        by_id: dict[str, dict] = {}
        for c in sorted(calls, key=lambda c: (c["turn"] is None, c["turn"], c["arguments"] or "")):
            by_id.setdefault(c["call_id"], c)
        items, invalid, unanswered = [], 0, 0
        for i in order:
            c = by_id[i]
            try:
                arguments: Any = json.loads(c["arguments"] if c["arguments"] is not None else "null")
                canonical(arguments)
                schema = schemas.get(c["name"])
                errors = ["$: unknown tool"] if schema is None else violations(arguments, schema)
            except ValueError:
                arguments, errors = c["arguments"], ["$: not JSON"]
            invalid += bool(errors)
            unanswered += c["content"] is None
            items.append({"arguments": arguments, "errors": errors, "id": i, "name": c["name"], "result": c["content"]})
        text = canonical({"calls": items, "conv_id": conv_id, "orphans": sorted(o["call_id"] for o in orphans)})
        return conv_id, len(items), unanswered, len(orphans), invalid, len(stuck), text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_calls", "n_unanswered", "n_orphans", "n_invalid", "n_cyclic", "json"]
        kinds = [pa.int64(), *[pa.int32()] * 5, pa.string()]
        for batch in batches:
            rows = [one(i, e) for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, n_calls, n_unanswered, n_orphans, n_invalid, n_cyclic, json), a row for each conversation that has a call or result.

    ``json`` has the calls in topological order with their arguments, what these violate, and their results, and the
    ids of results without a call (orphans).  Defined results: rows without a conv_id or call_id take no part; of
    calls that repeat an id the one of the smallest turn, then arguments, counts, of results the one of the smallest
    turn, then content; of calls that may come next the one of the smallest turn, then id, does; arguments that aren't JSON and unknown tools are invalid; a result's null content is no
    answer; calls on or behind a cycle come last; very long texts are written whole; empty tables give no rows; other
    columns are not read.
    """
    tune(calls.sparkSession)
    calls = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min_by(F.struct("turn", "name", "arguments", "after"), F.struct(F.coalesce("turn", F.lit(1 << 62)), "arguments")).alias("c"))
    results = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min_by("content", F.struct(F.coalesce("turn", F.lit(1 << 62)), "content")).alias("content"))
    linked = calls.join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer")
    event = F.struct("call_id", F.coalesce("c.turn", F.lit(0)).cast("long").alias("turn"), "c.name", "c.arguments", "c.after", "content")
    per_conv = linked.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.collect_list(event).alias("events"))
    return per_conv.mapInArrow(_write(SCHEMAS if schemas is None else schemas), "conv_id long, n_calls int, n_unanswered int, n_orphans int, n_invalid int, n_cyclic int, json string")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """link() of the calls that the turns stand for (calls_of_turns) together with those written in the messages.

    A conversation of neither, as of system turns only, has no row; see link and calls_of_turns for nulls, empty and very
    long texts, ties, repeated rows, empty tables and other columns.
    """
    calls, results = calls_of_turns(conversations)
    written_calls, written_results = calls_of_messages(conversations)
    return link(calls.unionByName(written_calls), results.unionByName(written_results))


def oracle() -> str:
    """The same for conversations without written calls and without repeated turns."""
    return """
WITH u AS (SELECT conv_id, turn, text, 'c' || conv_id || '-' || turn AS id FROM conversations WHERE role = 'user'),
s AS (SELECT *, lag(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations WHERE role IN ('user', 'assistant')),
a AS (SELECT conv_id, 'c' || conv_id || '-' || coalesce(asked, turn - 1) AS id, text AS content FROM s WHERE role = 'assistant'),
l AS (SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.id, a.id) AS id, u.turn, u.id IS NOT NULL AS is_call, a.content,
             CASE WHEN u.id IS NULL THEN NULL ELSE '{"arguments":{"prompt":' || to_json(u.text) || ',"turn":' || u.turn || '},"errors":[' ||
                  CASE WHEN u.text = '' THEN '"$.prompt: minLength"' ELSE '' END || '],"id":' || to_json(u.id) || ',"name":"reply","result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || '}' END AS item,
             u.text = '' AS invalid
      FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.id = a.id)
SELECT conv_id, count(*) FILTER (is_call)::INTEGER AS n_calls, count(*) FILTER (is_call AND content IS NULL)::INTEGER AS n_unanswered,
       count(*) FILTER (NOT is_call)::INTEGER AS n_orphans, count(*) FILTER (invalid)::INTEGER AS n_invalid, 0::INTEGER AS n_cyclic,
       '{"calls":[' || coalesce(string_agg(item, ',' ORDER BY turn) FILTER (is_call), '') || '],"conv_id":' || conv_id || ',"orphans":[' ||
       coalesce(string_agg(to_json(id), ',' ORDER BY id) FILTER (NOT is_call), '') || ']}' AS json
FROM l GROUP BY conv_id"""

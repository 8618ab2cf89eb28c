r"""Chat formatting with linked tool calls.

Calls and results meet in a hash join on (conversation, call id). Calls are ordered topologically:
a call comes after the calls it depends on, otherwise as its turn says. Arguments are validated against the
schema of their function, and every event becomes a line of canonical JSON (keys sorted, no blanks,
characters unescaped). A conversation is never gathered: events are ranked by a range sort, and
first-wins choices are aggregates that combine before the shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import WORD, shipped, staged, table, word_count
from veriscope.operators.ordering import rank_within

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}
#: Levels of nesting that are read; deeper arguments are kept as text and reported.
DEPTH = 200
_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and characters unescaped; lone surrogates, which no UTF-8 holds, become U+FFFD."""
    return _LONE.sub("\ufffd", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def depth(text: str) -> int:
    """Deepest nesting of brackets outside strings."""
    now = most = 0
    for mark in _BRACKETS.findall(_STRINGS.sub("", text)):
        now += 1 if mark in "[{" else -1
        most = max(most, now)
    return most


_STRINGS, _BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL), re.compile(r"[\[\]{}]")


def parsed(text: str | None) -> tuple[object, str | None]:
    """A JSON text as a value, or the text itself and why it is none. Numbers beyond a double's range are none."""
    if text is None:
        return None, None
    if depth(text) > DEPTH:
        return text, "nested too deep"
    try:
        value = json.loads(text, parse_constant=_no_number)
        canonical(value)  # fails for numbers like 1e999
        return value, None
    except ValueError:
        return text, "no JSON"


def _names(value, place: str) -> str:
    return f"{place}.{value}" if place else str(value)


def validate(value, rules, place: str = "") -> list[str]:
    """What a schema objects to: type (one or a list), enum, required, properties, additionalProperties and items, at any depth.

    Keywords that are not known say nothing; one of a wrong form is an objection to the schema itself.
    """
    out: list[str] = []
    open_ = [(value, rules, place)]
    while open_:
        v, r, at = open_.pop()
        if r is True:
            continue
        if not isinstance(r, dict):
            out.append(f"{at or 'arguments'}: schema is not an object")
            continue
        kinds = r.get("type", [])
        kinds = kinds if isinstance(kinds, list) else [kinds]
        unknown = [k for k in kinds if not isinstance(k, str) or k not in _TYPES]
        if unknown:
            out.append(f"{at or 'arguments'}: schema has an unknown type")
        elif kinds and not any(_TYPES[k](v) for k in kinds):
            out.append(f"{at or 'arguments'} is not {' or '.join(kinds)}")
            continue
        choices = r.get("enum")
        if isinstance(choices, list) and not any(canonical(v) == canonical(c) for c in choices):
            out.append(f"{at or 'arguments'} is none of the choices")
        if isinstance(v, dict):
            known = r.get("properties", {})
            known = known if isinstance(known, dict) else {}
            needed = r.get("required", [])
            out += [f"missing {_names(n, at)}" for n in (needed if isinstance(needed, list) else []) if n not in v]
            more = r.get("additionalProperties", True)
            for name in sorted(v, reverse=True):
                if name in known:
                    open_.append((v[name], known[name], _names(name, at)))
                elif more is False:
                    out.append(f"unexpected {_names(name, at)}")
                elif isinstance(more, dict):
                    open_.append((v[name], more, _names(name, at)))
        elif isinstance(v, list) and "items" in r:
            open_ += [(x, r["items"], f"{at}[{i}]") for i, x in reversed(list(enumerate(v)))]
    return out


def problems(arguments: str | None, schema: str | None) -> tuple[object, list[str]]:
    """Parsed arguments (their text where they are no JSON) and what is wrong with them; never an exception."""
    value, why = parsed(arguments)
    if schema is None:
        return value, ["unknown function"]
    rules, broken = parsed(schema)
    if broken or not isinstance(rules, dict):
        return value, ["schema is not an object"]
    if why == "nested too deep":
        return value, [why]
    if not isinstance(value, dict):
        return value, ["arguments are not an object"]
    return value, validate(value, rules)


def _checked(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for ids, names, arguments, schemas in frames:
        out = []
        for i, n, a, s in zip(ids, names, arguments, schemas, strict=True):
            value, wrong = problems(a, s)
            out.append((canonical({"arguments": value, "id": i, "name": n, "type": "tool_call"}), _LONE.sub("\ufffd", "; ".join(wrong))))
        yield pd.DataFrame(out, columns=["json", "errors"])


def _lines(kind: str, names: tuple[str, ...]):
    def run(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in frames:
            yield pd.Series([canonical({**dict(zip(names, x, strict=True)), "type": kind}) for x in zip(*columns, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): rounds until all dependencies of a call are placed; null in or behind a cycle.

    Dependencies that name no call of the conversation, or the call itself, do not bind. A round touches the
    calls that are still open; there are as many rounds as the deepest dependency has steps.
    """
    known = calls.select("conv_id", "call_id")
    edges = staged(
        calls.select("conv_id", "call_id", F.explode("depends").alias("on")).filter("on <> call_id").distinct()
        .join(known.withColumnRenamed("call_id", "on"), ["conv_id", "on"]),
        "edges",
    )
    bound = edges.select("conv_id", "call_id").distinct()
    placed = staged(known.join(bound, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    done, level = placed, 0
    while True:
        level += 1
        rest = edges.join(done.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_anti")
        waiting = rest.select("conv_id", "call_id").distinct()
        fresh = staged(
            bound.join(done, ["conv_id", "call_id"], "left_anti").join(waiting, ["conv_id", "call_id"], "left_anti")
            .withColumn("level", F.lit(level)),
            "levels",
        )
        if fresh.isEmpty():
            return known.join(done, ["conv_id", "call_id"], "left")
        done = done.unionByName(fresh)


def link_tool_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Events of all conversations in order: conv_id, position (from 1), kind, call_id, status, json.

    messages (conv_id, turn, role, content), calls (conv_id, turn, call_id, name, arguments, depends),
    results (conv_id, turn, call_id, content), schemas (name, schema: a JSON text). Of calls or results with one
    id in a conversation the first by turn and text counts, the others have status `duplicate` and stay
    without a link. A call is `ok`, `invalid: <why>`, `unanswered` or `cycle`; a result `ok` or
    `orphan`; a message `ok`. A call moves behind what it depends on, a result behind its call. Null
    conversation or call ids are values like others; null texts are JSON null; other columns are left out.
    Equal events are kept each; empty tables are fine. Arguments that are no JSON or nested beyond DEPTH are kept as text and
    reported, as is a schema that is none; of schemas with one name the first by its text counts.
    """
    # of several schemas of one name the first by its text counts
    schemas = schemas.groupBy(F.col("name").alias("s_name")).agg(F.min("schema").alias("schema"))
    calls = shipped(calls).select(
        F.col("conv_id").cast("string"), F.col("turn").cast("long"), F.coalesce(F.col("call_id").cast("string"), F.lit("")).alias("call_id"),
        "name", "arguments", F.coalesce("depends", F.array().cast("array<string>")).alias("depends"),
    ).withColumn("conv_id", F.coalesce("conv_id", F.lit("")))
    results = results.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.col("turn").cast("long"),
        F.coalesce(F.col("call_id").cast("string"), F.lit("")).alias("call_id"), "content",
    )
    calls = staged(calls.withColumn("row", F.monotonically_increasing_id()), "calls")
    results = staged(results.withColumn("row", F.monotonically_increasing_id()), "results")
    ids = ["conv_id", "call_id"]
    first_call = calls.groupBy(*ids).agg(
        F.min_by(F.struct("row", "turn", "depends"), F.struct("turn", "name", "arguments", "row")).alias("c")
    ).select(*ids, F.col("c.row").alias("c_row"), F.col("c.turn").alias("c_turn"), F.col("c.depends").alias("depends"))
    first_result = results.groupBy(*ids).agg(
        F.min_by("row", F.struct("turn", "content", "row")).alias("r_row")
    )
    own = staged(
        first_call.join(levels(first_call.select(*ids, "depends")), ids, "left").join(first_result, ids, "left"), "linked"
    )
    # the turn of a call is at least that of what it depends on, over any number of steps
    turns = own.select(*ids, F.col("c_turn").alias("turn"), "level")
    edges = own.filter("level > 0").select(*ids, "level", F.explode("depends").alias("on"))
    top = own.agg(F.coalesce(F.max("level"), F.lit(0)).alias("n")).first().n
    for level in range(1, top + 1):
        on = turns.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
        late = edges.filter(F.col("level") == level).join(on, ["conv_id", "on"]).groupBy(*ids).agg(F.max("on_turn").alias("late"))
        turns = staged(turns.join(late, ids, "left").select(*ids, F.greatest("turn", "late").alias("turn"), "level"), "turns")
    placed = staged(
        own.join(turns.select(*ids, F.col("turn").alias("at")), ids).select(*ids, "c_row", "r_row", "level", "at"), "placed"
    )
    by_id = placed.select(*[F.col(c).alias(f"p_{c}") for c in placed.columns])
    on = lambda x: (F.col("p_conv_id") == x.conv_id) & (F.col("p_call_id") == x.call_id)

    checked = F.pandas_udf(_checked, "json string, errors string")
    linked = calls.join(by_id, on(calls)).join(schemas, F.col("name") == F.col("s_name"), "left")
    call_rows = linked.withColumn("x", checked("call_id", "name", "arguments", "schema")).select(
        "conv_id", F.coalesce("p_at", "turn").alias("at"), F.coalesce("p_level", F.lit(1 << 30)).alias("level"), F.lit(1).alias("step"),
        F.lit("call").alias("kind"), "call_id",
        F.when(F.col("row") != F.col("p_c_row"), "duplicate").when(F.col("p_level").isNull(), "cycle")
        .when(F.col("x.errors") != "", F.concat(F.lit("invalid: "), F.col("x.errors")))
        .when(F.col("p_r_row").isNull(), "unanswered").otherwise("ok").alias("status"),
        F.col("x.json").alias("json"),
    )
    result_rows = results.join(by_id, on(results), "left").select(
        "conv_id", F.greatest("turn", "p_at").alias("at"), F.coalesce("p_level", F.lit(1 << 30)).alias("level"), F.lit(2).alias("step"),
        F.lit("result").alias("kind"), "call_id",
        F.when(F.col("p_conv_id").isNull(), "orphan").when(F.col("row") != F.col("p_r_row"), "duplicate").otherwise("ok").alias("status"),
        _lines("tool_result", ("content", "id"))("content", "call_id").alias("json"),
    )
    message_rows = messages.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.col("turn").cast("long").alias("at"), F.lit(0).alias("level"),
        F.lit(0).alias("step"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"),
        _lines("message", ("content", "role"))("content", "role").alias("json"),
    )
    events = message_rows.unionByName(call_rows).unionByName(result_rows)
    order = [F.col(c).asc_nulls_first() for c in ("at", "level", "step", "call_id", "status", "json")]
    return rank_within(events, ["conv_id"], order, "position", equal_rows=True).select(
        "conv_id", F.col("position").cast("long"), "kind", "call_id", "status", "json"
    )


SCHEMA = {
    "properties": {"question": {"type": "string"}, "n_words": {"type": "integer"}},
    "required": ["n_words", "question"], "additionalProperties": False,
}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, calls and results of plain conversations.

    A user turn is a call of `answer` (id conv-turn), an assistant turn right behind it is its result and every
    other turn a message. Calls after turn 0 depend on the conversation's call of turn 0, if it has one.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    number = lambda t: F.concat_ws("-", "conv_id", t)
    asked = rows.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("asked")).distinct()
    calls = rows.filter("role = 'user'").select(
        "conv_id", "turn", number(F.col("turn")).alias("call_id"), F.lit("answer").alias("name"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("question"), word_count(F.col("text")).alias("n_words"))).alias("arguments"),
        F.when(F.col("turn") > 0, F.array(number(F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("depends"),
    )
    answered = rows.filter("role IS NULL OR role <> 'user'").join(asked, ["conv_id", "turn"], "left")
    is_result = F.col("asked").isNotNull() & (F.col("role") == "assistant")
    results = answered.filter(is_result).select("conv_id", "turn", number(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    messages = answered.filter(~F.coalesce(is_result, F.lit(False))).select("conv_id", "turn", "role", F.col("text").alias("content"))
    return messages, calls, results


@query("op5_tool_call_linking", rf"""
WITH c AS (SELECT DISTINCT conv_id, turn + 1 AS turn FROM conversations WHERE role = 'user'),
r AS (
  SELECT v.*, c.turn IS NOT NULL AND role = 'assistant' AS answers FROM conversations v LEFT JOIN c USING (conv_id, turn)),
e AS (
  SELECT conv_id::VARCHAR AS conv_id, turn AS place,
    CASE WHEN role = 'user' THEN 'call' WHEN answers THEN 'result' ELSE 'message' END AS kind,
    CASE WHEN role = 'user' THEN conv_id || '-' || turn WHEN answers THEN conv_id || '-' || (turn - 1) END AS call_id,
    CASE WHEN role = 'user' AND NOT EXISTS (SELECT 1 FROM r x WHERE x.conv_id = r.conv_id AND x.turn = r.turn + 1 AND x.answers)
      THEN 'unanswered' ELSE 'ok' END AS status,
    CASE WHEN role = 'user' THEN json_object('arguments', json_object('n_words', len(regexp_extract_all(text, '{WORD}')), 'question', text),
        'id', conv_id || '-' || turn, 'name', 'answer', 'type', 'tool_call')
      WHEN answers THEN json_object('content', text, 'id', conv_id || '-' || (turn - 1), 'type', 'tool_result')
      ELSE json_object('content', text, 'role', role, 'type', 'message') END::VARCHAR AS json FROM r)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, kind = 'result', call_id, json) AS position, kind, call_id, status, json
FROM e""")
def op5_tool_call_linking(spark: SparkSession, folder: str) -> DataFrame:
    messages, calls, results = turns_as_calls(table(spark, folder, "conversations"))
    schemas = spark.createDataFrame([("answer", json.dumps(SCHEMA))], "name string, schema string")
    return link_tool_calls(messages, calls, results, schemas)

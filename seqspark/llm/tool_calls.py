"""Chat formatting: tool calls are linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on (conversation, call id), each side reduced to one row an id first; what
is over is returned by itself. The topological
level of a call is found in rounds over the dependency edges alone: a call whose dependencies all have a level gets one too, and a chain of calls
that each wait for one other is halved in every round by pointing past the call waited for, so a long chain takes few rounds. The order of a
conversation is (level, turn, id); it is returned as columns, so no conversation is gathered in one task.
Arguments are checked against the tool's schema, and rows serialised, by a small function over Arrow batches.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

#: Tool name to its parameters: name to (type, required, values allowed or None).
SCHEMAS = {
    "search": {"query": ("string", True, None), "limit": ("integer", True, None)},
    "lookup": {"query": ("string", True, None), "lang": ("string", False, ["de", "en", "es", "fr"])},
    "count": {"query": ("string", True, None), "limit": ("integer", False, None), "exact": ("boolean", False, None)},
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


#: Stands for a null conversation while rows are linked; the result has an empty string.
_NO_CONV = "\u0000"
_LONE = re.compile("[\ud800-\udfff]")


def _valid(text: str) -> str:
    """``text`` with surrogates that stand alone escaped, as UTF-8 has no form of them."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """Sorted keys, no spaces, UTF-8 kept but lone surrogates escaped, whole floats as integers; NaN and infinities become null."""

    def plain(x):
        if isinstance(x, float):
            return (int(x) if x.is_integer() else x) if math.isfinite(x) else None
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return _valid(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def parsed(text: str | None):
    """``(arguments, problem)``: the parsed JSON text, an empty object for none; the text itself if it is no JSON, or nests too deep to be read or written."""
    try:
        value = json.loads(text or "{}")
        canonical([value])
        return value, None
    except RecursionError:
        return text, "arguments nest too deep"
    except ValueError:
        return text, "arguments are no JSON"


def problems(name: str | None, arguments, schemas: dict) -> str | None:
    """The first thing wrong with a call's arguments, or None."""
    if name not in schemas:
        return "unknown tool"
    if not isinstance(arguments, dict):
        return "arguments are no object"
    schema = schemas[name]
    for k in sorted(arguments):
        if k not in schema:
            return f"unknown argument {k}"
        kind, _, values = schema[k]
        x = arguments[k]
        if not isinstance(x, _TYPES[kind]) or (isinstance(x, bool) and kind in ("integer", "number")):
            return f"{k} is no {kind}"
        if values is not None and x not in values:
            return f"{k} has another value"
    missing = sorted(k for k, (_, required, _) in schema.items() if required and k not in arguments)
    return f"{missing[0]} is missing" if missing else None


def levels(edges: DataFrame) -> DataFrame:
    """``(conv, id, level)`` for the dependants of ``edges`` (conv, id, dep): one more than their deepest dependency; null in or behind a cycle.

    A row of ``left`` is a call without a level and one of its open dependencies (null for none), the steps to that, and ``base``, the level that the
    others give it at least. Each round takes the calls without open dependencies off, then lets a call with one of them that has one itself skip it.
    """
    key = ["conv", "id"]
    edges = written(edges.select("conv", "id", "dep").distinct(), "op4-edges")
    inner = edges.select("conv", F.col("id").alias("dep")).distinct().withColumn("inner", F.lit(True))
    first = edges.join(inner.hint("merge"), ["conv", "dep"], "left")
    step = F.lit(1).cast("long")
    left = written(first.select(*key, F.when(F.col("inner"), F.col("dep")).alias("dep"), step.alias("step"), F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("base")), "op4-open")
    done = None

    def state_of(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy(*key).agg(F.max("base").alias("base"), F.count_distinct("dep").alias("n"), F.min("dep").alias("dep"), F.max("step").alias("step")), "op4-state")

    while True:
        state = state_of(left)
        ready = state.where("n = 0").select(*key, F.col("base").alias("level"))
        if ready.isEmpty():
            stuck = state.select(*key, F.lit(None).cast("long").alias("level"))
            out = stuck if done is None else done.unionByName(stuck)
            return out.withColumn("level", F.col("level").cast("int"))
        done = ready if done is None else done.unionByName(ready)
        open_ = left.join(ready.select(*key).hint("merge"), key, "left_anti")
        met = open_.join(ready.select("conv", F.col("id").alias("dep"), "level").hint("merge"), ["conv", "dep"], "left")
        known = F.col("level").isNotNull()
        solved = met.select(*key, F.when(~known, F.col("dep")).alias("dep"), "step", F.when(known, F.greatest("base", F.col("level") + F.col("step"))).otherwise(F.col("base")).alias("base"))
        solved = written(solved.groupBy(*key, "dep").agg(F.max("step").alias("step"), F.max("base").alias("base")), "op4-solved")
        now = state_of(solved)
        ahead = now.where("n = 1").select("conv", F.col("id").alias("dep"), F.col("dep").alias("next"), F.col("step").alias("far"), F.col("base").alias("under"))
        own = now.where("n = 1").select(*key, F.lit(True).alias("one"))
        met = solved.join(own.hint("merge"), key, "left").join(ahead.hint("merge"), ["conv", "dep"], "left")
        jump = F.coalesce(F.col("one") & F.col("next").isNotNull() & (F.col("step") + F.col("far") < 1 << 40), F.lit(False))  # round a cycle the steps only grow
        rows = met.select(*key, F.when(jump, F.col("next")).otherwise(F.col("dep")).alias("dep"), F.when(jump, F.col("step") + F.col("far")).otherwise(F.col("step")).alias("step"), F.when(jump, F.greatest("base", F.col("under") + F.col("step"))).otherwise(F.col("base")).alias("base"))
        before, left = left, written(rows, "op4-open")
        discard(before, solved, now)


def _rows(rows: DataFrame, schemas: dict) -> DataFrame:
    """``rows`` (conv, id, name, call_turn, result_turn, level, called, has, arguments, content, mark) checked and written as JSON; ``mark`` is a status set beforehand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.to_pylist():
                args, bad = parsed(x["arguments"])
                bad = (bad or problems(x["name"], args, schemas)) if x["called"] else None
                bad = bad and _valid(bad)
                status = x["mark"] or ("orphan_result" if not x["called"] else "cycle" if x["level"] is None else "invalid" if bad else "ok" if x["has"] else "pending")
                body = {"arguments": args if x["called"] else None, "content": x["content"], "id": x["id"], "name": x["name"], "status": status}
                out.append((bad, status, canonical(body)))
            texts = [pa.array(list(col), pa.string()) for col in (zip(*out) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *texts], ["conv", "id", "name", "call_turn", "result_turn", "level", "problem", "status", "json"])

    return rows.mapInArrow(run, "conv string, id string, name string, call_turn long, result_turn long, level int, problem string, status string, json string")


def _marked(rows: DataFrame, mark: str, called: bool) -> DataFrame:
    """Calls or results (conv, id, turn, name, arguments, content, as far as there) as rows of a status of their own."""
    get = lambda c: (F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c)
    turn, none = F.col("turn").cast("long"), F.lit(None).cast("long")
    return rows.select(
        F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv"), get("id"), get("name"), (turn if called else none).alias("call_turn"), (none if called else turn).alias("result_turn"),
        F.lit(None).cast("int").alias("level"), F.lit(called).alias("called"), F.lit(False).alias("has"), get("arguments"), get("content"), F.lit(mark).alias("mark"),
    )


def _others(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows with an id that aren't in ``kept``, identical ones as often as they are there: a count a distinct row, so a common id isn't one task's."""
    left = rows.withColumn("__n", F.lit(1)).unionByName(kept.withColumn("__n", F.lit(-1))).groupBy(*rows.columns).agg(F.sum("__n").alias("__n")).where("__n > 0")
    return left.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).drop("col")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS, whole: bool = False) -> DataFrame:
    """One row for each call and each result without a call: ``(conv, id, name, call_turn, result_turn, level, problem, status, json)``.

    ``calls`` has (conv, id, turn, name, arguments, deps), ``results`` (conv, id, turn, content); ``arguments`` is JSON text, ``deps`` an array
    of call ids of the conversation; ids it doesn't know are ignored. Of several calls or results of an id the one with the smallest turn, then
    content, is linked. A null conversation is one of its own. ``status`` is the first that holds of: ``orphan_result``, ``cycle``,
    ``invalid`` (see ``problem``), ``pending`` (no result), ``ok``. Other columns are ignored. With ``whole``, every further call and result is a row too:
    ``no_id`` without an id, ``duplicate`` if another row of its id is linked; without, these are left out.
    """
    key = ["conv", "id"]
    conv = F.coalesce(F.col("conv").cast("string"), F.lit(_NO_CONV)).alias("conv")
    calls = calls.select(conv, "id", F.col("turn").cast("long").alias("turn"), "name", "arguments", "deps")
    results = results.select(conv, "id", F.col("turn").cast("long").alias("turn"), "content")
    c1 = calls.where("id is not null").groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "deps")).alias("c")).select(*key, "c.*")
    c = written(c1.withColumnRenamed("turn", "call_turn"), "op4-calls")
    r1 = results.where("id is not null").groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r")).select(*key, "r.*")
    r = r1.withColumnRenamed("turn", "result_turn").withColumn("has", F.lit(True))
    asked = c.select("conv", "id", F.explode("deps").alias("dep"))
    edges = asked.join(c.select("conv", F.col("id").alias("dep")).hint("shuffle_hash"), ["conv", "dep"], "left_semi").select("conv", "id", "dep")
    lev = written(levels(edges), "op4-levels").withColumn("known", F.lit(True))
    both = c.withColumn("called", F.lit(True)).join(lev.hint("shuffle_hash"), key, "left").join(r.hint("shuffle_hash"), key, "full")
    level = F.when(F.col("called").isNull(), None).when(F.col("known").isNull(), 0).otherwise(F.col("level")).alias("level")
    rows = both.select(*key, "name", "call_turn", "result_turn", level, F.coalesce("called", F.lit(False)).alias("called"), F.coalesce("has", F.lit(False)).alias("has"), "arguments", "content")
    rows = rows.withColumn("mark", F.lit(None).cast("string"))
    if whole:
        for x, linked, called in ((calls, c.withColumnRenamed("call_turn", "turn"), True), (results, r1, False)):
            rows = rows.unionByName(_marked(x.where("id is null"), "no_id", called)).unionByName(_marked(_others(x.where("id is not null"), linked), "duplicate", called))
    return _rows(rows.withColumn("conv", F.when(F.col("conv") != _NO_CONV, F.col("conv")).otherwise("")), schemas)


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results drawn from plain conversation turns: an assistant turn calls a tool chosen by its text, a user turn is the result of the call just before it.

    A call's query is the whole text of its turn. A third of the calls depend on the call two turns before. Some arguments break the tool's schema, as their limit is text. A turn
    whose conversation or number is null gets no id, as nothing says which turns belong together.
    """
    sid = lambda t: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    text = F.coalesce(F.col("text"), F.lit(""))
    pick = F.crc32(F.encode(text, "utf-8"))
    query, limit = text.alias("query"), F.length(text)
    args = F.when(pick % 7 == 0, F.to_json(F.struct(limit.cast("string").alias("limit"), query))).otherwise(F.to_json(F.struct(query, limit.alias("limit"))))
    args = F.when(pick % 3 == 1, F.to_json(F.struct(query, F.lit("en").alias("lang")))).otherwise(args)
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("count")), (pick % 3).cast("int") + 1)
    deps = F.when(pick % 9 < 3, F.array_compact(F.array(sid(F.col("turn") - 2)))).otherwise(F.array().cast("array<string>"))
    calls = turns.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), sid(F.col("turn")).alias("id"), "turn", name.alias("name"), args.alias("arguments"), deps.alias("deps"))
    results = turns.where("role = 'user'").select(F.col("conv_id").alias("conv"), sid(F.col("turn") - 1).alias("id"), "turn", F.col("text").alias("content"))
    return calls, results


def format_turns(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """The rows of :func:`link_calls`, with all that is linked to none, over the calls and results of plain turns, and a row of status ``message``, named by its role, for each turn of another role (null too)."""
    calls, results = calls_of_turns(turns)
    other = turns.where("role is null or role not in ('assistant', 'user')").select(F.col("conv_id").alias("conv"), "turn", F.col("role").alias("name"), F.col("text").alias("content"))
    return link_calls(calls, results, schemas, whole=True).unionByName(_rows(_marked(other, "message", False), schemas))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_turns(table(spark, sf_dir, "conversations"))

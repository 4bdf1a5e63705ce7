"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Messages are rows (conv_id, turn, role, text). An assistant's message whose text is a JSON object
with ``tool_calls`` (a list of id, name, arguments and after, the ids it waits for) makes calls;
a tool's message whose text is a JSON object with ``tool_call_id`` and ``content`` is a result.

Calls and results are hash-joined by conversation and identifier: a call takes the first result
of its identifier that does not precede it. The topological level of a call is 0 if it waits for
no call of its conversation, else one above the highest it waits for; levels are found by joins,
one round for each level, and calls in a cycle stay without one. Arguments are validated against
the schema of the tool: required names, no unknown names, types. Every message becomes one line
of canonical JSON: sorted keys, no white space, text as it is; its calls stand in order of level,
then of their place in the message.

Defined results: a null text is the empty text, a null role is ``unknown``, a message whose text is not
such an object is plain. Repeated rows (equal in all four columns) are one message. A call
without id has no result; of several calls with one id in a conversation the first is linked, the
others are ``duplicate``. Arguments that are no JSON object, and tools without schema, are
invalid. Results without call are ``orphan``. Messages with a null conv_id are one conversation;
a null turn comes before all others. Text that is no JSON that can be written again as UTF-8 (NaN,
numbers out of range, lone surrogates, nested too deeply) stays text. Extra columns are ignored; an
empty table gives an empty result. Conversations are never gathered into one row or task: only the
calls of one message are, and identifiers that very many results share are joined by broadcast of
their one call.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import Scratch, attach

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
RESULT = "tool_call_id string, content string"
KEY = ("conv", "at", "part")  #: conversation and turn without nulls; part tells apart different messages of one turn

#: The tools of the default catalogue, with type and need of each argument.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True)},
    "translate": {"text": ("string", True), "target": ("string", True)},
}

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fits(arguments: object, schema: Mapping[str, tuple[str, bool]] | None) -> bool:
    """Whether the arguments are an object that the schema allows."""
    if schema is None or not isinstance(arguments, dict):
        return False
    if any(need and name not in arguments for name, (_, need) in schema.items()):
        return False
    return all(
        name in schema and isinstance(v, TYPES[schema[name][0]]) and (schema[name][0] == "boolean") == isinstance(v, bool)
        for name, v in arguments.items()
    )


def _finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError(text)
    return value


def _refuse(text: str) -> None:
    raise ValueError(text)


def _loads(text: str | None) -> object:
    """The JSON value of a text, or the text where it is none that can be written again."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite)
        canonical([[[[[[[[value]]]]]]]]).encode()  # with room for the record around it
    except (ValueError, RecursionError):
        return text
    return value


def parse(messages: DataFrame) -> DataFrame:
    """Messages with their key, calls (array or null) and result (struct or null)."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "at": F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))), "part": F.xxhash64("role", "text")})
    is_object = F.col("text").rlike(r"^\s*\{")
    calls = F.when((F.col("role") == "assistant") & is_object & F.col("text").contains("tool_calls"), F.from_json("text", CALLS)["tool_calls"])
    result = F.when((F.col("role") == "tool") & is_object, F.from_json("text", RESULT))
    return rows.withColumn("calls", calls).withColumn("result", F.when(result["tool_call_id"].isNotNull(), result))


def link(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with their results (content) and status, and the keys of results that a call took."""
    calls = parsed.where("calls is not null").select(*KEY, F.posexplode("calls").alias("place", "call")).select(*KEY, "place", "call.*")
    first = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("at", "part", "place")).alias("first"))
    first = first.select("conv", "id", "first.*")
    results = parsed.where("result is not null").select("conv", F.col("at").alias("r_at"), F.col("part").alias("r_part"), F.col("result.tool_call_id").alias("id"), F.col("result.content").alias("content"))
    asked = results.groupBy("conv", "id").agg(F.count("*").alias("n")).join(first, ["conv", "id"])
    pair = F.concat_ws("\x00", "conv", "id")
    met = attach(results.withColumn("pair", pair).drop("conv", "id"), asked.withColumn("pair", pair), "pair", "n").where("r_at >= at")
    taken = met.groupBy(*KEY, "place").agg(F.min(F.struct("r_at", "r_part", "content")).alias("took"))
    linked = calls.join(first.select(*KEY, "place", F.lit(True).alias("first")), [*KEY, "place"], "left").join(taken, [*KEY, "place"], "left")
    status = F.when(F.col("id").isNotNull() & F.col("first").isNull(), "duplicate").when(F.col("took").isNull(), "open").otherwise("linked")
    linked = linked.select(*KEY, "place", "id", "name", "arguments", "after", F.coalesce("first", F.lit(False)).alias("first"), F.col("took.content").alias("content"), status.alias("status"))
    used = taken.select("conv", F.col("took.r_at").alias("at"), F.col("took.r_part").alias("part")).distinct().withColumn("used", F.lit(True))
    return linked, used


def levels(spark: SparkSession, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, id and level of the first call of each id; calls in or behind a cycle are left out."""
    nodes = linked.where("first").select("conv", "id")
    waits = linked.where("first").select("conv", "id", F.explode("after").alias("need")).distinct()
    needed = nodes.select("conv", F.col("id").alias("need"))
    waits = scratch.keep(waits.join(needed, ["conv", "need"], "left_semi"), "waits")
    done = scratch.keep(nodes.join(waits, ["conv", "id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    level = 0
    while not waits.isEmpty():
        level += 1
        waits = scratch.keep(waits.join(done.select("conv", F.col("id").alias("need")), ["conv", "need"], "left_anti"), "waits")
        ready = nodes.join(waits, ["conv", "id"], "left_anti").join(done, ["conv", "id"], "left_anti")
        ready = scratch.keep(ready.withColumn("level", F.lit(level)), "levels")
        if ready.isEmpty():
            break
        done = done.union(ready)
    return done


def format_chats(spark: SparkSession, messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """conv_id, turn, role, n_calls, n_linked, n_invalid, status and record (canonical JSON) of every message."""
    tools = dict(SCHEMAS if schemas is None else schemas)
    scratch = Scratch(spark, "chats")
    parsed = parse(messages)
    special = scratch.keep(parsed.where("calls is not null or result is not null"), "special")

    @F.pandas_udf(T.BooleanType())
    def valid(name: pd.Series, arguments: pd.Series) -> pd.Series:
        return pd.Series([fits(_loads(a), tools.get(n)) for n, a in zip(name, arguments, strict=True)], dtype=bool)

    linked, used = link(special)
    linked = scratch.keep(linked.withColumn("valid", valid("name", "arguments")), "linked")
    level = levels(spark, linked, scratch)
    one = F.struct(F.coalesce("level", F.lit(1 << 30)).alias("level"), "place", "id", "name", "arguments", "status", "content", "valid")
    own = linked.join(level, ["conv", "id"], "left").groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("linked"))
    rows = special.join(own, list(KEY), "left").join(used, list(KEY), "left")
    status = F.when(F.col("calls").isNotNull(), "calls").when(F.col("used"), "result").otherwise("orphan")
    count = lambda f: F.coalesce(F.size(F.filter("linked", f)), F.lit(0)).cast("long")
    rows = rows.select("conv_id", "turn", "role", "text", F.to_json("linked").alias("linked"), F.col("result.content").alias("content"), F.col("result.tool_call_id").alias("call"),
                       count(lambda c: F.lit(True)).alias("n_calls"), count(lambda c: c["status"] == "linked").alias("n_linked"), count(lambda c: ~c["valid"]).alias("n_invalid"), status.alias("status"))
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    plain = parsed.where("calls is null and result is null").select("conv_id", "turn", "role", "text", none.alias("linked"), none.alias("content"), none.alias("call"), zero.alias("n_calls"), zero.alias("n_linked"), zero.alias("n_invalid"), F.lit("plain").alias("status"))

    @F.pandas_udf(T.StringType())
    def record(turn: pd.Series, role: pd.Series, text: pd.Series, linked: pd.Series, content: pd.Series, call: pd.Series) -> pd.Series:
        out = []
        for n, r, t, calls, c, i in zip(turn, role, text, linked, content, call, strict=True):
            line: dict = {"role": r, "turn": None if pd.isna(n) else int(n)}
            if isinstance(calls, str):
                line["tool_calls"] = [
                    {"arguments": _loads(x.get("arguments")), "id": x.get("id"), "level": None if x["level"] == 1 << 30 else x["level"], "name": x.get("name"), "result": _loads(x.get("content")), "status": x["status"], "valid": x["valid"]}
                    for x in json.loads(calls)
                ]
            elif isinstance(i, str):
                line |= {"content": _loads(c if isinstance(c, str) else None), "tool_call_id": i}
            else:
                line["content"] = t
            out.append(canonical(line))
        return pd.Series(out, dtype=object)

    both = rows.unionByName(plain)
    return both.select("conv_id", "turn", "role", "n_calls", "n_linked", "n_invalid", "status", record("turn", "role", "text", "linked", "content", "call").alias("record"))

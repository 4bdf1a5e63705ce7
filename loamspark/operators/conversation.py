"""Conversation memory (X58, X59): what a thread is about, as bounded aggregates of its user messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

#: Wordings that change the memory, and how much of each list is kept.
PATTERNS = {
    "reset": r"\b(start over|reset)\b",
    "resume": r"\b(back to|resume|continue)\b",
    "pause": r"\b(pause|hold)\b",
    "goal": r"\b(i need|i want|help me|goal is)\b",
    "clarification": r"(\bactually|instead|clarif)",
    "context": r"\b(today|tomorrow|budget|deadline|prefer)\b",
    "preference": r"\bprefer\b",
}
SUBJECT, SERVICE = r"(?:about|for)\s+([^?.!]+)", r"(?:service|package)\s*(?:is|:)?\s*([^?.!]+)"
KEPT = {"follow_ups": 20, "clarifications": 12, "context": 12, "preferences": 20, "details": 40}
CHARS = 500
SUMMARY_MESSAGES, SUMMARY_USER, SUMMARY_CHARS = 12, 3, 180


def identity(value: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), 1, 48)


def memory(messages: DataFrame) -> DataFrame:
    """The memory of each conv_id from messages (conv_id, turn, role, text).

    A reset forgets what came before it, so the fold is a set of aggregates over the user messages
    after the last reset; Spark adds them up before the shuffle and a conversation of any length is
    never gathered. Of the bounded lists the sizes are given.
    """
    value = F.substring(T.clean(F.col("text")), 1, CHARS)
    user = messages.where("role = 'user'").select("conv_id", "turn", value.alias("value")).withColumn("low", F.lower("value"))
    user = user.withColumns({k: T.matches(F.col("low"), p) for k, p in PATTERNS.items()})
    last = user.groupBy("conv_id").agg(F.max(F.when(F.col("reset"), F.col("turn"))).alias("reset_turn"))
    own = user.join(last, "conv_id").withColumn("live", F.col("reset_turn").isNull() | (F.col("turn") > F.col("reset_turn")))
    live = lambda test, x: F.when(F.col("live") & test, x)
    subject, service = (F.trim(F.regexp_extract("value", "(?i)" + p, 1)) for p in (SUBJECT, SERVICE))
    newest = lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("turn")))
    state = F.when(F.col("pause"), "paused").when(F.col("resume"), "active")
    question = T.matches(F.col("value"), r"\?\s*$")
    some = F.col("value") != ""
    return own.groupBy("conv_id").agg(
        F.coalesce(newest(live(state.isNotNull(), state)), F.lit("active")).alias("status"),
        newest(live(subject != "", subject)).alias("subject"),
        newest(live(F.col("goal"), F.col("value"))).alias("goal"),
        newest(live(service != "", service)).alias("service"),
        F.least(F.count_distinct(live(question, F.col("value"))), F.lit(KEPT["follow_ups"])).alias("n_follow_ups"),
        F.least(F.count(live(F.col("clarification"), 1)), F.lit(KEPT["clarifications"])).alias("n_clarifications"),
        F.least(F.count(live(F.col("context"), 1)), F.lit(KEPT["context"])).alias("n_context"),
        F.least(F.count_distinct(live(F.col("preference"), identity(F.col("value")))), F.lit(KEPT["preferences"])).alias("n_preferences"),
        F.least(F.count_distinct(live(some, identity(F.col("value")))), F.lit(KEPT["details"])).alias("n_details"),
    )


def summary(messages: DataFrame, after: int = -1) -> DataFrame:
    """The next part of each conversation's summary: its twelve first messages after turn ``after``,
    the last three of a user in them, and the turn up to which they reach."""
    order = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    fresh = messages.where(F.col("turn") > after).select("conv_id", "turn", "role", "text", order.alias("n")).where(F.col("n") <= SUMMARY_MESSAGES)
    said = F.when(F.col("role") == "user", F.struct("turn", F.substring(T.clean(F.col("text")), 1, SUMMARY_CHARS).alias("value")))
    out = fresh.groupBy("conv_id").agg(F.max("turn").alias("covered"), F.count("*").alias("n_messages"), F.sort_array(F.collect_list(said)).alias("said"))
    recent = F.slice(F.transform("said", lambda s: s["value"]), F.greatest(F.lit(1), F.size("said") - SUMMARY_USER + 1), F.lit(SUMMARY_USER))
    return out.select("conv_id", "covered", "n_messages", F.array_join(recent, "; ").alias("updates"))

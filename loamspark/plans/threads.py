"""Thread decisions on the given conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import threads as O
from . import registry as R
from .registry import Tables, query

c = F.col
#: What the turns decide, and texts that they propose; words of the conversation are added to some.
CYCLE = ["continue", "sidetrack", "continue", "resume", "topic_change", "continue", "sidetrack", "resume", "reset", "continue", "resume"]


def turns(t: Tables) -> DataFrame:
    """A decision and a proposal for each turn of the conversations, in numbers that follow each other."""
    key = c("conv_id") * 3 + c("turn")
    words = F.substring(c("text"), 1, 24)
    pick = F.element_at(F.array(*map(F.lit, CYCLE)), (key % len(CYCLE)).cast("int") + 1)
    own = t.conversations.where("conv_id is not null and turn is not null").dropDuplicates(["conv_id", "turn"])
    return own.select(
        c("conv_id").alias("thread"), "turn", pick.alias("decision"), F.when(key % 3 == 0, words).when(key % 7 == 0, "").alias("goal"), F.when(key % 4 == 0, F.concat(F.lit("On "), words)).when(key % 5 == 0, "ok!").alias("subject"),
        F.when(key % 5 == 1, F.concat(F.lit(" the  service "), (key % 6).cast("string"))).alias("service"), F.when(key % 2 == 0, F.concat(F.lit("Summary "), key.cast("string"))).when(key % 9 == 0, "hmm").alias("summary"),
        F.when(key % 4 == 1, F.array(F.lit("A b"), F.lit("a  B "), F.concat(F.lit("c"), (key % 3).cast("string")))).alias("constraints"), F.lit(None).cast("array<string>").alias("details"), F.lit(None).cast("array<string>").alias("questions"),
        F.when(key % 6 == 1, F.array(F.lit(""), F.lit("why"))).alias("clarifications"),
    )


def _fold_sql() -> str:
    low = lambda x: f"(length({x}) < 4 OR regexp_full_match(lower({x}), '(ok|okay|cool|yes|yep|sure|thanks|thank you|got it|nice|lol|maybe|hmm|wait|hold on)[.!?]*'))"
    core = lambda f: f"""CASE WHEN e.decision = 'reset' THEN NULL WHEN e.decision = 'sidetrack' THEN s.{f} WHEN e.decision = 'resume' THEN coalesce(s.p{f}, s.{f}, {put(f)}) ELSE {put(f)} END"""
    put = lambda f: f"CASE WHEN e.{f} IS NULL{'' if f == 'service' else f' OR (e.{f} <> {chr(39) * 2} AND {low(f'e.{f}')})'} THEN s.{f} ELSE nullif(e.{f}, '') END"
    paused = lambda f, own: f"CASE WHEN e.decision IN ('reset', 'topic_change') THEN NULL WHEN e.decision = 'sidetrack' THEN s.{own} ELSE s.{f} END"
    refused = lambda f, name: f"CASE WHEN e.decision = 'sidetrack' AND nullif(e.{f}, '') IS DISTINCT FROM s.{f} THEN 'sidetrack_{name}_overwrite_blocked' END"
    weak = lambda f: f"CASE WHEN e.{f} IS NOT NULL{'' if f == 'summary' else f' AND e.{f} <> {chr(39) * 2}'} AND {low(f'e.{f}')} AND (e.decision <> 'sidetrack' OR {'true' if f == 'summary' else f'nullif(e.{f}, {chr(39) * 2}) IS NOT DISTINCT FROM s.{f}'}) THEN 'low_signal_{f}_blocked' END"
    constraints = "CASE WHEN e.decision IN ('reset', 'topic_change') THEN [] WHEN e.decision = 'sidetrack' THEN s.constraints WHEN e.decision = 'resume' THEN coalesce(s.pconstraints, s.constraints) ELSE coalesce(e.constraints, s.constraints) END"
    return f"""u AS (SELECT DISTINCT ON (conv_id, turn) conv_id AS thread, turn, conv_id * 3 + turn AS key, substr(text, 1, 24) AS words FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        e AS (SELECT thread, turn, row_number() OVER (PARTITION BY thread ORDER BY turn) AS n, {CYCLE!r}[key % {len(CYCLE)} + 1] AS decision, {R.clean('words')} AS w,
              CASE WHEN key % 3 = 0 THEN {R.clean('words')} WHEN key % 7 = 0 THEN '' END AS goal, CASE WHEN key % 4 = 0 THEN {R.clean("'On ' || words")} WHEN key % 5 = 0 THEN 'ok!' END AS subject,
              CASE WHEN key % 5 = 1 THEN 'the service ' || key % 6 END AS service, CASE WHEN key % 2 = 0 THEN 'Summary ' || key WHEN key % 9 = 0 THEN 'hmm' END AS summary,
              CASE WHEN key % 4 = 1 THEN ['A b', 'c' || key % 3] END AS constraints, CASE WHEN key % 6 = 1 THEN ['why'] END AS clarifications FROM u),
        f(thread, turn, n, decision, status, goal, subject, service, constraints, clarifications, summary, sidetrack, pgoal, psubject, pservice, pconstraints, failures) AS (
          SELECT DISTINCT thread, NULL::BIGINT, 0::BIGINT, NULL::VARCHAR, 'active', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[], '{O.START}', false, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR[], '' FROM e
          UNION ALL
          SELECT s.thread, e.turn, e.n, e.decision, CASE WHEN e.decision = 'sidetrack' THEN 'paused' ELSE 'active' END, {core('goal')}, {core('subject')}, {core('service')}, {constraints},
                 CASE WHEN e.decision IN ('reset', 'topic_change') THEN [] ELSE coalesce(e.clarifications, s.clarifications) END, CASE WHEN e.decision = 'reset' THEN '{O.START}' WHEN e.summary IS NULL OR {low('e.summary')} THEN s.summary ELSE e.summary END,
                 CASE WHEN e.decision = 'sidetrack' THEN true WHEN e.decision = 'continue' THEN s.sidetrack ELSE false END, {paused('pgoal', 'goal')}, {paused('psubject', 'subject')}, {paused('pservice', 'service')}, {paused('pconstraints', 'constraints')},
                 concat_ws(',', {refused('goal', 'primary_goal')}, {refused('subject', 'subject')}, {refused('service', 'service')}, {weak('summary')}, {weak('goal')}, {weak('subject')})
          FROM f s JOIN e ON e.thread = s.thread AND e.n = s.n + 1)"""


@query(f"WITH RECURSIVE {_fold_sql()} SELECT thread, turn, decision, status, goal, subject, service, array_to_string(constraints, '|') AS constraints, array_to_string(clarifications, '|') AS clarifications, summary, sidetrack, pgoal AS paused_goal, failures FROM f WHERE n > 0")
def x61_thread_memory(t: Tables) -> DataFrame:
    found = O.thread_memory(turns(t), span=4)
    return found.withColumns({k: F.array_join(k, "|") for k in ("constraints", "clarifications")}).drop("details", "questions", "changed")

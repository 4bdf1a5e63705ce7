"""Governance appends on entries made of orders (X34c, X34d, X34f, X34g)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import governance as O
from ..session import cut, shuffled
from .memory import _pick, _sha
from .registry import Tables, query

c = F.col
STATES = ["proposed", "approved", "corrected", "archived"]
NEXT = ["approved", "corrected", "archived", "proposed", "approved"]


def _tables(t: Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
    k = c("o_orderkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    base = t.orders.select(c("o_custkey").alias("project"), F.when(k % 3 == 0, "faq").otherwise("context_entry").alias("kind"), text("e", k).alias("entry"), k.alias("k"), c("o_orderpriority").alias("priority"))
    own = ["project", "kind", "entry"]
    before = base.where("k % 11 > 0").select(*own, _pick(STATES, c("k")).alias("status"), text("old ", c("k") % 9).alias("content"), F.lit("t0").alias("updated"))
    after = base.select(*own, _pick(NEXT, F.floor(c("k") / 4)).alias("status"), F.when(c("k") % 7 < 3, text(" new ", c("k") % 9, " ")).otherwise(text("old ", c("k") % 9)).alias("content"), F.lit("t1").alias("updated"))
    claim = lambda name, content, created: base.select(*own, text(name, c("k")).alias("claim"), content.alias("content"), F.lit(created).alias("created"), text("s", c("k")).alias("snapshot"), F.lit("fact").alias("type"), F.lit("policy").alias("category"), c("priority").alias("title"))
    claims = claim("c", text("old ", c("k") % 9), "t0").unionByName(claim("d", text("new ", c("k") % 9), "t00").where("cast(substring(claim, 2, 20) as long) % 13 = 0"))
    claims = claims.where("cast(substring(claim, 2, 20) as long) % 17 > 0")
    evidence = base.select(text("c", c("k")).alias("claim"), F.explode(F.array(text("x", c("k")), text("y", c("k")))).alias("evidence"))
    trusted = base.where("k % 5 > 0").select(*own, text("t", c("k")).alias("id"), text("c", c("k")).alias("claim"), F.lit("r").alias("review"), F.lit(None).cast("string").alias("previous"), (c("k") % 4 + 1).alias("revision"), F.lit("active").alias("lifecycle"), F.lit("t0").alias("created"))
    return O.transitions(before, after), {"claims": claims, "evidence": evidence, "trusted": trusted}


def _staged(t: Tables) -> dict[str, DataFrame]:
    moves, stored = _tables(t)
    return O.stage(moves, stored["claims"], stored["evidence"], stored["trusted"])


_ACTION = "CASE was || ':' || status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.ACTIONS.items()) + " END"
MOVES = f"""e AS (SELECT o_custkey AS project, CASE WHEN o_orderkey % 3 = 0 THEN 'faq' ELSE 'context_entry' END AS kind, 'e' || o_orderkey AS entry, o_orderkey AS k, {STATES!r}[o_orderkey % 4 + 1] AS was, {NEXT!r}[o_orderkey // 4 % 5 + 1] AS status,
                     CASE WHEN o_orderkey % 7 < 3 THEN 'new ' ELSE 'old ' END || o_orderkey % 9 AS content, o_orderkey % 7 < 3 AS changed FROM orders WHERE o_orderkey % 11 > 0),
    m0 AS (SELECT *, CASE WHEN was = status THEN CASE WHEN status = 'corrected' AND changed THEN 'correction' END ELSE {_ACTION} END AS action,
                  CASE WHEN was = status AND status = 'approved' AND changed THEN 'content_changed_without_corrected_status' WHEN was <> status AND {_ACTION} IS NULL THEN 'invalid_review_transition' END AS code FROM e),
    m AS (SELECT * FROM m0 WHERE action IS NOT NULL OR code IS NOT NULL)"""
STAGED = f"""{MOVES}, f AS (SELECT *, k % 17 > 0 AS has_old, k % 17 > 0 AND k % 13 = 0 AS has_new, k % 5 > 0 AS has_trusted FROM m WHERE code IS NULL),
    g AS (SELECT *, CASE WHEN changed THEN has_new ELSE has_old END AS has_equal, CASE WHEN changed THEN has_old ELSE has_new END AS has_before FROM f),
    h AS (SELECT *, CASE WHEN (action = 'correction' AND NOT has_before) OR (action <> 'correction' AND NOT has_equal) THEN 'canonical_governance_candidate_missing' WHEN action IN ('archive', 'unapprove') AND NOT has_trusted THEN 'canonical_governance_archive_without_trusted_knowledge' END AS no,
                 CASE WHEN has_equal THEN CASE WHEN changed THEN 'd' ELSE 'c' END || k ELSE {_sha('candidate_claim', "'s' || k", "'fact'", 'kind', 'entry', 'content')} END AS claim FROM g),
    s AS (SELECT *, {_sha('claim_review', 'project::VARCHAR', 'kind', 'entry', 'claim', "CASE WHEN action = 'unapprove' THEN 'archive' ELSE action END", "'t1'")} AS review FROM h WHERE no IS NULL)"""


@query(f"WITH {MOVES} SELECT project, kind, entry, was AS previous_status, status, content, action, code FROM m")
def x34c_review_transitions(t: Tables) -> DataFrame:
    return _tables(t)[0].drop("updated")


@query(f"""WITH {STAGED} SELECT project, kind, entry, {_sha('trusted_knowledge', 'project::VARCHAR', 'kind', 'entry', 'review')} AS id, claim, review, CASE WHEN has_trusted THEN 't' || k END AS previous, CASE WHEN has_trusted THEN k % 4 + 2 ELSE 1 END AS revision,
           CASE WHEN action IN ('archive', 'unapprove') THEN 'archived' ELSE 'active' END AS lifecycle, 't1' AS created FROM s WHERE action <> 'reject'""")
def x34d_trusted_revisions(t: Tables) -> DataFrame:
    return _staged(t)["trusted"]


@query(f"""WITH {STAGED} SELECT claim, unnest(['x' || k, 'y' || k]) AS evidence, content, o_orderpriority AS title FROM s JOIN orders ON o_orderkey = k WHERE action = 'correction' AND NOT has_equal AND has_old AND changed""")
def x34f_corrected_claims(t: Tables) -> DataFrame:
    """Claims that corrections made, with the evidence that they inherit."""
    staged = _staged(t)
    return staged["claims"].join(staged["evidence"], "claim").select("claim", "evidence", "content", "title")


@query(f"WITH {STAGED} SELECT project, kind, entry, code FROM m WHERE code IS NOT NULL UNION ALL SELECT project, kind, entry, no FROM h WHERE no IS NOT NULL")
def x34d_refused_transitions(t: Tables) -> DataFrame:
    return _staged(t)["refused"]


@query(f"""WITH {STAGED}, r AS (SELECT project, count(*) AS reviews, count(*) FILTER (WHERE action <> 'reject') AS trusted, bool_or(k % 19 = 0) AS clash FROM s GROUP BY project)
           SELECT project, CASE WHEN clash THEN 0 ELSE reviews END AS new_reviews, CASE WHEN clash THEN 0 ELSE trusted END AS new_trusted, 0 AS replayed, 0 AS mismatches, clash AS held FROM r""")
def x34g_published(t: Tables) -> DataFrame:
    """Projects' new rows; where a stored review has another content nothing is published; a replay of the rest writes nothing."""
    moves, stored = _tables(t)
    staged = O.stage(moves, stored["claims"], stored["evidence"], stored["trusted"])
    staged = {name: cut(staged[name]) for name in ("reviews", "trusted")}
    clash = staged["reviews"].where("cast(substring(entry, 2, 20) as long) % 19 = 0").withColumn("status", F.lit("other"))
    before = {"reviews": clash, "trusted": stored["trusted"]}
    after, held = O.publish(before, staged)
    again, _ = O.publish(after, staged)
    bad = O.mismatches(after, staged, held)
    count = lambda df, name: df.groupBy("project").agg(F.count("*").alias(name))
    out = staged["reviews"].select("project").distinct()
    for name, table, old in (("new_reviews", after["reviews"], before["reviews"]), ("new_trusted", after["trusted"], before["trusted"])):
        out = out.join(count(table.join(shuffled(old.select("id")), "id", "left_anti"), name), "project", "left")
    replayed = again["reviews"].select("project", "id").join(shuffled(after["reviews"].select("id")), "id", "left_anti")
    out = out.join(count(replayed, "replayed"), "project", "left").join(count(bad, "mismatches"), "project", "left").join(held.select("project", F.lit(True).alias("held")), "project", "left")
    return out.select("project", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("new_reviews", "new_trusted", "replayed", "mismatches")), F.coalesce("held", F.lit(False)).alias("held"))

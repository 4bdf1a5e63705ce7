"""Diffs, synchronisation and merging on two slices of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as O
from .registry import Tables, query

OLD, NEW = "l_linenumber <= 4", "l_linenumber >= 2 AND l_suppkey % 11 <> 0"


def _versions(t: Tables, which: str) -> DataFrame:
    step = F.floor(F.col("l_quantity") / 10).cast("long")
    step = step if which == OLD else F.when(F.col("l_partkey") % 5 == 0, step + 1).otherwise(step)
    hash = F.md5(F.concat_ws("|", "l_returnflag", step.cast("string")).cast("binary"))
    return t.lineitem.where(which).select(F.col("l_orderkey").alias("base"), hash.alias("hash"), F.format_string("%d-%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("version"))


SIDES = f"""
    o AS (SELECT *, row_number() OVER (PARTITION BY base, hash ORDER BY version) AS nth, row_number() OVER (PARTITION BY base ORDER BY hash, version) - 1 AS slot, count(*) OVER (PARTITION BY base) AS size
          FROM (SELECT l_orderkey AS base, md5(concat_ws('|', l_returnflag, floor(l_quantity / 10)::BIGINT::VARCHAR)) AS hash, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS version FROM lineitem WHERE {OLD})),
    n AS (SELECT *, row_number() OVER (PARTITION BY base, hash ORDER BY version) AS nth, row_number() OVER (PARTITION BY base ORDER BY hash, version) - 1 AS slot
          FROM (SELECT l_orderkey AS base, md5(concat_ws('|', l_returnflag, (floor(l_quantity / 10)::BIGINT + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END)::VARCHAR)) AS hash, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS version FROM lineitem WHERE {NEW})),
    f AS (SELECT coalesce(o.base, n.base) AS base, o.version AS ov, n.version AS nv, o.hash AS oh, n.hash AS nh, o.slot AS os, n.slot AS ns FROM o FULL JOIN n ON o.base = n.base AND o.hash = n.hash AND o.nth = n.nth),
    a AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY os) AS at FROM f WHERE nv IS NULL),
    b AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ns) AS at FROM f WHERE ov IS NULL),
    sizes AS (SELECT base, count(*) AS size FROM o GROUP BY base),
    d AS (SELECT base, os AS slot, 'unchanged' AS state, ov, nv FROM f WHERE ov IS NOT NULL AND nv IS NOT NULL
          UNION ALL SELECT coalesce(a.base, b.base), coalesce(a.os, coalesce(size, 0) + b.at - 1), CASE WHEN a.base IS NULL THEN 'added' WHEN b.base IS NULL THEN 'removed' ELSE 'changed' END, a.ov, b.nv
          FROM a FULL JOIN b ON a.base = b.base AND a.at = b.at LEFT JOIN sizes s ON s.base = coalesce(a.base, b.base))"""


@query(f"WITH {SIDES} SELECT base, slot::BIGINT AS slot, state, ov AS o_version, nv AS n_version, 'fact_logical_' || sha256(base || chr(0) || slot) AS logical_id FROM d")
def x21_multiset_diff(t: Tables) -> DataFrame:
    out = O.multiset_diff(_versions(t, OLD), _versions(t, NEW), "fact")
    return out.select("base", F.col("slot").cast("long").alias("slot"), "state", "o_version", "n_version", "logical_id")


@query(f"WITH {SIDES} SELECT state, count(*) AS n, count(DISTINCT base) AS bases FROM d GROUP BY state")
def a12_recrawl_counts(t: Tables) -> DataFrame:
    return O.multiset_diff(_versions(t, OLD), _versions(t, NEW), "fact").groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("base").alias("bases"))


@query(f"""WITH {SIDES}, moved AS (SELECT base, bool_or(state IN ('added', 'changed')) AS send, bool_and(state = 'unchanged') AS preserved FROM d GROUP BY base)
           SELECT o_orderkey, coalesce(send, false) AS send, coalesce(preserved, false) AS preserved FROM orders LEFT JOIN moved ON base = o_orderkey""")
def x22_extraction_plan(t: Tables) -> DataFrame:
    d = O.multiset_diff(_versions(t, OLD), _versions(t, NEW), "block")
    moved = d.groupBy("base").agg(F.bool_or(F.col("state").isin("added", "changed")).alias("send"), F.bool_and(F.col("state") == "unchanged").alias("preserved"))
    out = t.orders.select("o_orderkey").join(moved, F.col("base") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("send", F.lit(False)).alias("send"), F.coalesce("preserved", F.lit(False)).alias("preserved"))


SNAPSHOTS = """
    old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 7 <> 0),
    new AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 9 <> 0)"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey").alias("id")
    old = t.orders.where("o_orderkey % 7 <> 0").select(key, F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    status = F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    new = t.orders.where("o_orderkey % 9 <> 0").select(key, status.alias("status"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderpriority")).alias("priority"))
    return old, new


@query(f"""WITH {SNAPSHOTS}, joined AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'removed'
           WHEN o.status IS DISTINCT FROM n.status OR o.priority IS DISTINCT FROM n.priority THEN 'changed' ELSE 'unchanged' END AS state,
           concat_ws(',', CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END, CASE WHEN o.priority IS DISTINCT FROM n.priority THEN 'priority' END) AS diff FROM old o FULL JOIN new n ON o.id = n.id)
           SELECT id, state, CASE WHEN state = 'changed' THEN diff ELSE '' END AS fields FROM joined""")
def x24_knowledge_sync(t: Tables) -> DataFrame:
    return O.synchronise(*_snapshots(t), "id", ["status", "priority"])


@query(f"""WITH {SNAPSHOTS} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'missing' WHEN o.id IS NULL THEN 'unexpected' WHEN o.status <> n.status THEN 'mismatched' ELSE 'matched' END AS finding
           FROM old o FULL JOIN new n ON o.id = n.id""")
def x33_expected_vs_actual(t: Tables) -> DataFrame:
    return O.report(*_snapshots(t), ["id"], "status")


@query(f"""WITH {SNAPSHOTS}, f AS (SELECT CASE WHEN n.id IS NULL OR o.id IS NULL THEN 'major' WHEN o.status <> n.status THEN 'major' WHEN o.priority IS DISTINCT FROM n.priority THEN 'minor' ELSE 'match' END AS kind FROM old o FULL JOIN new n ON o.id = n.id)
           SELECT count(*) FILTER (WHERE kind = 'major') AS major, count(*) FILTER (WHERE kind = 'minor') AS minor, CASE WHEN count(*) FILTER (WHERE kind = 'major') > 0 THEN 'MAJOR' WHEN count(*) FILTER (WHERE kind = 'minor') > 0 THEN 'MINOR' ELSE 'MATCH' END AS status FROM f""")
def x38_parity(t: Tables) -> DataFrame:
    found = O.synchronise(*_snapshots(t), "id", ["status", "priority"])
    major = F.col("state").isin("new", "removed") | F.col("fields").contains("status")
    out = found.agg(F.count_if(major).alias("major"), F.count_if(~major & (F.col("state") == "changed")).alias("minor"))
    return out.withColumn("status", F.when(F.col("major") > 0, "MAJOR").when(F.col("minor") > 0, "MINOR").otherwise("MATCH"))


@query("""WITH c AS (SELECT o_custkey AS identity, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'proposed' ELSE 'corrected' END AS review,
              CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'confirmed' WHEN '2' THEN 'provided' WHEN '3' THEN 'observed' ELSE 'generated' END AS authority,
              CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS confidence, o_orderpriority AS value, o_orderkey % 3 AS ev FROM orders),
          r AS (SELECT *, (review IN ('approved', 'corrected'))::INT * 100000 + (review = 'corrected')::INT * 10000 + (authority = 'confirmed')::INT * 5000
                + CASE authority WHEN 'generated' THEN 0 WHEN 'observed' THEN 1 WHEN 'provided' THEN 2 ELSE 3 END * 100 + CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END * 10 + ev AS rank FROM c),
          g AS (SELECT identity, count(*) AS n, count(DISTINCT lower(value)) AS n_values, max(rank) AS top FROM r GROUP BY identity),
          w AS (SELECT g.*, count(*) AS n_best, min(id) AS winner FROM g JOIN r ON r.identity = g.identity AND r.rank = g.top GROUP BY ALL),
          k AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN n_values = 1 THEN 'agreement' WHEN n_best > 1 THEN 'unresolved_conflict' ELSE 'conflict' END AS classification FROM w)
          SELECT identity, classification, CASE WHEN classification <> 'unresolved_conflict' THEN winner END AS selected, n, n_values, classification = 'unresolved_conflict' AS requires_review FROM k""")
def x25_knowledge_merge(t: Tables) -> DataFrame:
    s, p, v = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("o_totalprice")
    review = F.when(s == "F", "approved").when(s == "O", "proposed").otherwise("corrected")
    authority = F.when(p == "1", "confirmed").when(p == "2", "provided").when(p == "3", "observed").otherwise("generated")
    confidence = F.when(v > 200000, "high").when(v > 100000, "medium").otherwise("low")
    rank = O.policy(review, authority, F.lit(False), confidence, F.col("o_orderkey") % 3)
    return O.merge(t.orders.select(F.col("o_custkey").alias("identity"), F.col("o_orderkey").alias("assertion_id"), F.col("o_orderpriority").alias("value"), rank.alias("policy")))

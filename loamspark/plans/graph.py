"""The memory graph on stand-ins: redirects, duplicates, rewiring, conflicts, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as Win

from ..operators import graph as O
from ..operators import windows as W
from .registry import Tables, query


def _redirects(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 10 <> 1 AND c_custkey % 3 <> 0").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") - 1).alias("dst"))


REDIRECTS = """r AS (SELECT c_custkey AS src, c_custkey - 1 AS dst FROM customer WHERE c_custkey % 10 <> 1 AND c_custkey % 3 <> 0),
    walk AS (SELECT src, dst FROM r UNION ALL SELECT w.src, r.dst FROM walk w JOIN r ON r.src = w.dst),
    ends AS (SELECT src, min(dst) AS dst FROM walk GROUP BY src)"""


@query(f"WITH RECURSIVE {REDIRECTS} SELECT src, dst FROM ends")
def j16_redirect_closure(t: Tables) -> DataFrame:
    return O.resolve_redirects(_redirects(t))


@query("""WITH s AS (SELECT l_suppkey AS query, l_partkey AS node FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1), e AS (SELECT DISTINCT l_partkey AS a, l_partkey % 50 + 1 AS b FROM lineitem)
          SELECT DISTINCT query, next AS node, edge FROM (SELECT query, b AS next, a * 1000 + b AS edge FROM s JOIN e ON a = node UNION ALL SELECT query, a, a * 1000 + b FROM s JOIN e ON b = node)
          x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query = x.query AND s.node = x.next)""")
def j15_one_hop(t: Tables) -> DataFrame:
    seeds = t.lineitem.where("l_quantity = 50 AND l_linenumber = 1").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("node")).distinct()
    edges = t.lineitem.select(F.col("l_partkey").alias("a"), (F.col("l_partkey") % 50 + 1).alias("b")).distinct()
    return O.neighbours(edges.withColumn("edge", F.col("a") * 1000 + F.col("b")), seeds)


@query("""WITH k AS (SELECT 'domain' AS kind, lower(trim(regexp_replace(host, '^www\\.', ''))) AS value, page_id AS entity_id, 'page' AS entity_type, true AS strong FROM
              (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)
            UNION ALL SELECT 'phone', regexp_replace(lower(s_name), '[^0-9+]', '', 'g'), s_suppkey, 'supplier', false FROM supplier WHERE length(regexp_replace(s_name, '[^0-9]', '', 'g')) BETWEEN 7 AND 15
            UNION ALL SELECT 'phone', regexp_replace(lower(c_name), '[^0-9+]', '', 'g'), c_custkey, 'customer', false FROM customer WHERE length(regexp_replace(c_name, '[^0-9]', '', 'g')) BETWEEN 7 AND 15),
          u AS (SELECT kind, value, entity_id, entity_type, bool_or(strong) AS strong FROM k WHERE value IS NOT NULL AND (kind <> 'domain' OR regexp_matches(value, '^(?:[a-z0-9-]+\\.)+[a-z]{2,63}$')) GROUP BY ALL)
          SELECT kind, value, count(*) AS n, min(entity_id) AS lead, CASE WHEN bool_or(strong) AND count(DISTINCT entity_type) = 1 THEN 'auto_merge' ELSE 'manual_review' END AS classification FROM u GROUP BY kind, value HAVING count(*) > 1""")
def x40_duplicate_candidates(t: Tables) -> DataFrame:
    def keys(df: DataFrame, kind: str, value, id: str, entity: str, strong: bool) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), O.identity_key(F.lit(kind), value).alias("value"), F.col(id).alias("entity_id"), F.lit(entity).alias("entity_type"), F.lit(strong).alias("strong"))

    host = F.regexp_replace(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), r"^www\.", "")
    every = keys(t.pages, "domain", host, "page_id", "page", True)
    every = every.union(keys(t.supplier, "phone", F.col("s_name"), "s_suppkey", "supplier", False)).union(keys(t.customer, "phone", F.col("c_name"), "c_custkey", "customer", False))
    return O.duplicate_candidates(every)


@query(f"""WITH RECURSIVE {REDIRECTS}, e AS (SELECT o_orderkey AS edge, o_orderpriority AS kind, o_custkey AS a, o_custkey % 40 + 1 AS b, o_orderdate AS seen FROM orders),
           x AS (SELECT edge, kind, coalesce(p.dst, a) AS a, coalesce(q.dst, b) AS b, seen FROM e LEFT JOIN ends p ON p.src = a LEFT JOIN ends q ON q.src = b)
           SELECT kind, a, b, arg_min(edge, (seen, edge)) AS edge, min(seen) AS seen, count(*) AS n FROM x WHERE a <> b GROUP BY kind, a, b""")
def x42_rewired_edges(t: Tables) -> DataFrame:
    edges = t.orders.select(F.col("o_orderkey").alias("edge"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("a"), (F.col("o_custkey") % 40 + 1).alias("b"), F.col("o_orderdate").alias("at"))
    return O.rewire(edges, O.resolve_redirects(_redirects(t))).withColumnRenamed("at", "seen")


@query("""SELECT o_custkey AS entity_id, o_orderstatus AS topic, count(DISTINCT o_orderpriority) AS n_values, count(*) AS n FROM orders
          WHERE o_totalprice > 50000 AND o_orderpriority NOT LIKE '5%' GROUP BY ALL HAVING count(DISTINCT o_orderpriority) > 1""")
def x43_assertion_conflicts(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderstatus").alias("topic"), F.col("o_orderpriority").alias("norm"), (F.col("o_totalprice") > 50000).alias("active"), F.lit("proposed").alias("review"), F.when(F.col("o_orderpriority").startswith("5"), "generated").otherwise("observed").alias("authority"))
    return O.assertion_conflicts(a)


DRIFT = """d AS (
    SELECT 'orders' AS model, o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_custkey % 17 = 0 THEN 'changed' END AS drift FROM orders WHERE o_orderkey % 19 <> 0
    UNION ALL SELECT 'orders', o_orderkey::VARCHAR, CASE WHEN o_orderkey % 13 <> 0 THEN 'extra' END FROM orders WHERE o_orderkey % 19 = 0
    UNION ALL SELECT 'parts', p_partkey::VARCHAR, CASE WHEN p_size > 45 THEN 'changed' END FROM part)"""


def _drift(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", F.md5(F.col("o_orderstatus").cast("binary")).alias("hash"))
    p = t.part.select("p_partkey", "p_size", F.md5(F.col("p_name").cast("binary")).alias("hash"))
    changed = lambda c: F.when(c, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash")
    desired = {"orders": o.where("o_orderkey % 19 <> 0").select(F.col("o_orderkey").alias("id"), "hash"), "parts": p.select(F.col("p_partkey").alias("id"), "hash")}
    persisted = {"orders": o.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("id"), changed(F.col("o_custkey") % 17 == 0)), "parts": p.select(F.col("p_partkey").alias("id"), changed(F.col("p_size") > 45))}
    return O.drift(desired, persisted, "id", "hash")


@query(f"WITH {DRIFT} SELECT * FROM d WHERE drift IS NOT NULL")
def x44_drift(t: Tables) -> DataFrame:
    return _drift(t)


@query(f"WITH {DRIFT} SELECT model, key, drift, CASE drift WHEN 'missing' THEN 1 WHEN 'changed' THEN 2 ELSE 3 END AS rank, CASE drift WHEN 'missing' THEN 'insert' WHEN 'changed' THEN 'update' ELSE 'deactivate' END AS repair FROM d WHERE drift IS NOT NULL")
def x45_repair_plan(t: Tables) -> DataFrame:
    return O.repair_plan(_drift(t))


ACTIONS = [*O.ACTIONS, "publish"]


@query(f"""WITH v AS (SELECT l_linestatus AS kind, l_orderkey AS item, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 23 = 0 THEN l_linenumber - 2 ELSE l_linenumber END AS revision,
                 CASE WHEN l_partkey % 29 = 0 THEN 'other' ELSE 'own' END AS project, CASE WHEN l_partkey % 31 <> 0 THEN l_partkey END AS review, CASE WHEN l_partkey % 37 = 0 THEN 'other' ELSE 'own' END AS review_project,
                 l_partkey % 41 AS claim, CASE WHEN l_suppkey % 19 = 0 THEN 0 ELSE l_partkey % 41 END AS review_claim, CASE WHEN l_partkey % 43 <> 0 THEN {ACTIONS!r}[l_partkey % 5 + 1] END AS action,
                 CASE WHEN (l_partkey % 5 = 2) <> (l_suppkey % 17 = 0) THEN 'archived' ELSE 'active' END AS lifecycle,
                 CASE WHEN l_partkey % 13 = 0 THEN l_orderkey * 10 ELSE lag(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_linestatus, l_orderkey ORDER BY l_linenumber) END AS predecessor FROM (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
          w AS (SELECT *, lag(id) OVER x AS b, lag(revision) OVER x AS br, lag(project) OVER x AS bp FROM v WINDOW x AS (PARTITION BY kind, item ORDER BY revision, id)),
          j AS (SELECT w.*, p.lifecycle AS pl FROM w LEFT JOIN v p ON p.kind = w.kind AND p.item = w.item AND p.id = w.predecessor)
          SELECT kind, item, id, unnest(list_filter([CASE WHEN revision < 1 THEN 'invalid_revision' END, CASE WHEN revision <= br THEN 'duplicate_or_unordered_revision' END,
                 CASE WHEN project <> 'own' THEN 'cross_project_trusted_knowledge' END, CASE WHEN review IS NULL OR review_project <> 'own' OR review_claim <> claim THEN 'cross_project_or_claim_review' END,
                 CASE WHEN coalesce(action, 'publish') = 'publish' THEN 'unsupported_or_missing_review_action' END, CASE WHEN (lifecycle = 'archived') <> (coalesce(action, '') = 'archive') THEN 'lifecycle_review_action_mismatch' END,
                 CASE WHEN lifecycle <> 'archived' AND coalesce(action, '') NOT IN ('approve', 'correction', 'restore') THEN 'missing_compatible_review' END,
                 CASE WHEN b IS NOT NULL AND predecessor IS DISTINCT FROM b THEN 'broken_predecessor_chain' END, CASE WHEN b IS NOT NULL AND predecessor = b AND bp <> 'own' THEN 'cross_project_or_logical_predecessor' END,
                 CASE WHEN b IS NULL AND predecessor IS NOT NULL THEN 'unexpected_first_predecessor' END, CASE WHEN action = 'restore' AND pl IS DISTINCT FROM 'archived' THEN 'restore_predecessor_invalid' END], lambda r: r IS NOT NULL)) AS reason FROM j""")
def x34h_history_integrity(t: Tables) -> DataFrame:
    part, supp, id_ = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    before = F.lag(id_).over(Win.partitionBy("l_linestatus", "l_orderkey").orderBy("l_linenumber"))
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_linestatus", "l_partkey", "l_suppkey")))
    rows = lines.select(
        F.col("l_linestatus").alias("kind"), F.col("l_orderkey").alias("item"), id_.alias("id"), F.when(supp % 23 == 0, F.col("l_linenumber") - 2).otherwise(F.col("l_linenumber")).alias("revision"),
        F.when(part % 29 == 0, "other").otherwise("own").alias("project"), F.when(part % 31 != 0, part).alias("review"), F.when(part % 37 == 0, "other").otherwise("own").alias("review_project"),
        (part % 41).alias("claim"), F.when(supp % 19 == 0, 0).otherwise(part % 41).alias("review_claim"),
        F.when(part % 43 != 0, F.element_at(F.array(*map(F.lit, ACTIONS)), (part % 5 + 1).cast("int"))).alias("action"),
        F.when((part % 5 == 2) != (supp % 17 == 0), "archived").otherwise("active").alias("lifecycle"), F.when(part % 13 == 0, F.col("l_orderkey") * 10).otherwise(before).alias("predecessor"),
    )
    return O.integrity(rows, F.lit("own"))


@query("""SELECT DISTINCT ON (o_custkey, o_orderpriority) o_custkey, o_orderpriority, o_orderkey AS revision, o_orderstatus <> 'F' AS live FROM orders ORDER BY o_custkey, o_orderpriority, o_orderdate DESC, o_orderkey DESC""")
def x34e_trusted_projection(t: Tables) -> DataFrame:
    out = W.latest(t.orders, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return out.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("revision"), (F.col("o_orderstatus") != "F").alias("live"))

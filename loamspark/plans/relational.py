"""Operational analytics (J18-J25, A13-A24, W1-W13, T9-T15, U1-U7) on the driver's star schema.

customer stands for projects, orders for jobs and purchases, lineitem for evidence, events for
the operational event stream, conversations for threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import windows as O
from .registry import Tables, query


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations")
def w1_message_sequence(t: Tables) -> DataFrame:
    return O.numbered(t.conversations, ["conv_id"], [F.col("turn")]).select("conv_id", "turn", "role", "seq")


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1 AS superseded
          FROM orders WHERE o_orderstatus = 'O'""")
def w2_one_active_job(t: Tables) -> DataFrame:
    active = t.orders.where("o_orderstatus = 'O'")
    n = O.numbered(active, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "n")
    return n.select("o_orderkey", "o_custkey", (F.col("n") > 1).alias("superseded"))


@query("""SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC""")
def w3_latest_revision(t: Tables) -> DataFrame:
    return O.latest(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("SELECT conv_id, max(turn) + 1 AS next_turn FROM conversations GROUP BY conv_id")
def w9_next_sequence(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"))


@query("""SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt_number,
                 coalesce(greatest(0, epoch_us(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) - epoch_us(ts)), 0) // 1000 AS duration_ms FROM events""")
def k7_telemetry_attempts(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    micro = lambda c: F.unix_micros(c.cast("timestamp"))
    us = F.greatest(F.lit(0), micro(F.lead("ts").over(w)) - micro(F.col("ts")))
    gap = F.floor(F.when(F.lead("ts").over(w).isNotNull(), us).otherwise(F.lit(0)) / 1000)
    return t.events.select("event_id", "user_id", "event_type", F.row_number().over(w).cast("long").alias("attempt_number"), gap.alias("duration_ms"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 14""")
def w12_last_messages(t: Tables) -> DataFrame:
    return O.first_rows(t.conversations, ["conv_id"], [F.col("turn").desc()], 14).select("conv_id", "turn", "role")


@query("""SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS previous_o_orderkey, lag(o_orderstatus) OVER w AS previous_o_orderstatus
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def w13_previous_revision(t: Tables) -> DataFrame:
    out = O.with_previous(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return out.select("o_orderkey", "o_custkey", "previous_o_orderkey", "previous_o_orderstatus")


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'
          ORDER BY o_orderdate, o_orderkey LIMIT 25""")
def t10_queue_claim(t: Tables) -> DataFrame:
    claimed = t.orders.where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(25)
    return claimed.select("o_orderkey", "o_custkey", F.row_number().over(W.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def t11_latest_activity(t: Tables) -> DataFrame:
    return t.events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(30).select("event_id", "user_id", "event_type")


@query("""SELECT event_type, count(*) AS total, max(ts) AS last_ts, arg_max(event_id, (epoch_us(ts), event_id)) AS last_event,
                 count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def t12_operational_status(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("total"), F.max("ts").alias("last_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.countDistinct("user_id").alias("users"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def t13_keyset_page(t: Tables) -> DataFrame:
    return O.page(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 100)


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderdate DESC, o_orderkey) AS place FROM orders""")
def t14_archived_last(t: Tables) -> DataFrame:
    order = [F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return O.numbered(t.orders, ["o_custkey"], order, "place").select("o_orderkey", "place")


@query("""SELECT 'signup' AS kind, event_id AS id, user_id AS owner, ts AS at FROM events WHERE event_type = 'signup'
          UNION ALL SELECT 'error', event_id, user_id, ts FROM events WHERE event_type = 'error'
          UNION ALL SELECT 'order', o_orderkey, o_custkey, o_orderdate FROM orders
          UNION ALL SELECT 'ship', l_orderkey, min(l_suppkey), max(l_shipdate) FROM lineitem GROUP BY l_orderkey
          UNION ALL SELECT 'purchase', max(event_id), user_id, max(ts) FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def u1_activity_feed(t: Tables) -> DataFrame:
    def feed(df: DataFrame, kind: str, id: str, owner: str, at: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(id).alias("id"), F.col(owner).alias("owner"), F.col(at).alias("at"))

    e = t.events
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.max("l_shipdate").alias("d"))
    bought = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("e"), F.max("ts").alias("d"))
    out = feed(e.where("event_type = 'signup'"), "signup", "event_id", "user_id", "ts")
    out = out.unionByName(feed(e.where("event_type = 'error'"), "error", "event_id", "user_id", "ts"))
    out = out.unionByName(feed(t.orders, "order", "o_orderkey", "o_custkey", "o_orderdate"))
    return out.unionByName(feed(shipped, "ship", "l_orderkey", "s", "d")).unionByName(feed(bought, "purchase", "e", "user_id", "d"))


@query("""SELECT l.doc_id, 'quality' AS kind, CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS state FROM labels l
          UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 'flagged' ELSE 'clear' END FROM labels""")
def u2_review_items(t: Tables) -> DataFrame:
    one = t.labels.select("doc_id", F.lit("quality").alias("kind"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("state"))
    return one.unionByName(t.labels.select("doc_id", F.lit("toxic").alias("kind"), F.when(F.col("toxic") == 1, "flagged").otherwise("clear").alias("state")))


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT l_suppkey) AS n_sources, count(DISTINCT o_orderkey) > 0 AS has_orders
          FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def j18_project_counts(t: Tables) -> DataFrame:
    # Each branch is reduced to its key before the join, so the fan-out of both is never built.
    pairs = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sources = pairs.groupBy("o_custkey").agg(F.countDistinct("l_suppkey").alias("n_sources"))
    jobs = t.orders.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n_orders")).join(sources, "o_custkey", "left")
    out = t.customer.select("c_custkey").join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select("c_custkey", zero(F.col("n_orders")).alias("n_orders"), zero(F.col("n_sources")).alias("n_sources"), (zero(F.col("n_orders")) > 0).alias("has_orders"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j19_purchases_with_projects(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("""SELECT l_orderkey, l_linenumber, o_custkey, c_nationkey, n_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
          LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def j20_provenance_chain(t: Tables) -> DataFrame:
    out = t.lineitem.select("l_orderkey", "l_linenumber").join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = out.join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey", "n_name")


@query("""SELECT DISTINCT p_partkey, s_suppkey, s_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey""")
def j21_claim_evidence_links(t: Tables) -> DataFrame:
    link = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    return link.join(t.part.select("p_partkey"), "p_partkey", "left_semi").join(t.supplier.select("s_suppkey", "s_name"), "s_suppkey").select("p_partkey", "s_suppkey", "s_name")


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)""")
def j22_not_supporting(t: Tables) -> DataFrame:
    used = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(used, "p_partkey", "left_anti")


@query("""SELECT e.event_id, e.user_id FROM events e WHERE e.event_type = 'error' AND NOT EXISTS
          (SELECT 1 FROM events r WHERE r.event_type = 'click' AND r.user_id = e.user_id AND (r.ts, r.event_id) > (e.ts, e.event_id))""")
def j23_unresolved_events(t: Tables) -> DataFrame:
    out = O.unresolved(t.events, ["user_id"], F.col("event_type") == "error", F.col("event_type") == "click")
    return out.select("event_id", "user_id")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j24_ownership_guard(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT source, min(doc_id) AS best_alias FROM documents d WHERE n_chars = (SELECT max(n_chars) FROM documents x WHERE x.source = d.source) GROUP BY source""")
def a13_best_alias(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("best_alias"))


@query("""SELECT o_custkey, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities FROM orders GROUP BY o_custkey""")
def a14_entity_rollup(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@query("""SELECT user_id, max(nullif(event_type, 'view')) AS last_type, min(ts) AS first_ts, coalesce(max(value), 0) AS top_value FROM events GROUP BY user_id""")
def a16_user_rollup(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max(F.nullif("event_type", F.lit("view"))).alias("last_type"), F.min("ts").alias("first_ts"), F.coalesce(F.max("value"), F.lit(0.0)).alias("top_value"))


@query("""SELECT count(*) FILTER (WHERE state = 'approved') AS approved, count(*) FILTER (WHERE state = 'rejected') AS rejected,
                 count(*) FILTER (WHERE state = 'flagged') AS flagged, count(*) AS total FROM
          (SELECT CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS state FROM labels
           UNION ALL SELECT CASE WHEN toxic = 1 THEN 'flagged' ELSE 'clear' END FROM labels)""")
def a17_review_counters(t: Tables) -> DataFrame:
    states = u2_review_items(t)
    return states.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("approved", "rejected", "flagged")), F.count("*").alias("total"))


@query("""SELECT o_custkey, array_to_string(list_sort(list(o_orderpriority || '=' || n)), ',') AS totals FROM
          (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def a18_category_totals(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    pair = F.concat_ws("=", "o_orderpriority", F.col("n").cast("string"))
    return n.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(pair)), ",").alias("totals"))


@query("""SELECT user_id, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR) AS in_hour,
                 count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS in_day,
                 count(*) FILTER (WHERE event_type = 'signup') AS active FROM events GROUP BY user_id""")
def a19_usage_windows(t: Tables) -> DataFrame:
    # The clock is one value; an aggregate of the stream in place of the wall clock.
    now = t.events.agg(F.max("ts").alias("now"))
    e = t.events.join(F.broadcast(now))
    return e.groupBy("user_id").agg(
        F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 1 HOUR")).alias("in_hour"),
        F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 1 DAY")).alias("in_day"),
        F.count_if(F.col("event_type") == "signup").alias("active"),
    )


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def a20_status_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM customer) AS projects, (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_jobs,
                 (SELECT count(*) FROM orders WHERE o_orderdate >= (SELECT max(date_trunc('day', o_orderdate)) FROM orders)) AS created_today""")
def a21_overview(t: Tables) -> DataFrame:
    day = t.orders.agg(F.max(F.date_trunc("day", "o_orderdate")).alias("today"))
    jobs = t.orders.join(F.broadcast(day)).agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "O").alias("open_jobs"), F.count_if(F.col("o_orderdate") >= F.col("today")).alias("created_today"))
    return t.customer.agg(F.count("*").alias("projects")).join(F.broadcast(jobs)).select("projects", "jobs", "open_jobs", "created_today")  # one row each


PRICES = (("PROMO", 3), ("PROMO BURNISHED", 5), ("STANDARD", 2), ("", 1))


@query("""WITH prices(prefix, cost) AS (VALUES ('PROMO', 3), ('PROMO BURNISHED', 5), ('STANDARD', 2), ('', 1)),
          best AS (SELECT p_partkey, arg_max(cost, length(prefix)) AS cost FROM part JOIN prices ON starts_with(p_type, prefix) GROUP BY p_partkey)
          SELECT l_suppkey, sum(cost * CAST(l_quantity AS BIGINT))::BIGINT AS micros FROM lineitem JOIN best ON p_partkey = l_partkey GROUP BY l_suppkey""")
def a22_cost_estimate(t: Tables) -> DataFrame:
    cost = F.lit(None).cast("long")
    for prefix, value in sorted(PRICES, key=lambda x: len(x[0])):  # the longest prefix wins
        cost = F.when(F.col("p_type").startswith(prefix), F.lit(value).cast("long")).otherwise(cost)
    priced = t.part.select("p_partkey", cost.alias("cost"))
    used = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return used.join(priced, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.sum(F.col("cost") * F.col("q")).alias("micros"))


@query("""SELECT (SELECT count(*) FROM labels WHERE quality = 1) + (SELECT count(*) FROM labels WHERE toxic = 0) AS passed,
                 (SELECT count(*) FROM labels WHERE quality = 0) + (SELECT count(*) FROM labels WHERE toxic = 1) AS failed""")
def a24_combined_counters(t: Tables) -> DataFrame:
    return u2_review_items(t).agg(F.count_if(F.col("state").isin("approved", "clear")).alias("passed"), F.count_if(F.col("state").isin("rejected", "flagged")).alias("failed"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                 CASE WHEN event_type = 'signup' THEN 'started' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'completed' ELSE 'progress' END AS update FROM events""")
def s7_event_progress(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("progress")
    return t.events.select("event_id", F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999")).cast("long").alias("k"), kind.alias("update"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'archived' ELSE 'active' END AS state, CASE WHEN c_acctbal < 0 THEN NULL ELSE upper(c_mktsegment) END AS title FROM customer""")
def k10_archive_and_rename(t: Tables) -> DataFrame:
    archived = F.col("c_acctbal") < 0
    return t.customer.select("c_custkey", F.when(archived, "archived").otherwise("active").alias("state"), F.when(~archived, F.upper("c_mktsegment")).alias("title"))

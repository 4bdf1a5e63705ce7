"""Operational events, conversation memory, sinks and readers on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversation as C
from ..operators import events as O
from ..sources import readers, writers
from . import registry as R
from .registry import Tables, lit, query

RANK = {"signup": 1, "view": 2, "click": 3, "purchase": 4, "error": 5}
STAGE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in RANK.items()) + " ELSE 0 END"


@query(f"SELECT user_id, max({STAGE}) AS stage, max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS progress, count(*) AS n_events FROM events GROUP BY user_id")
def z1_job_progress(t: Tables) -> DataFrame:
    return O.progress(t.events, "user_id", F.expr(STAGE), F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)"))


@query("""WITH j AS (SELECT event_id AS job_id, CASE WHEN event_type IN ('click', 'view') THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'queued' END AS status, event_id % 5 AS attempts, ts, (SELECT max(ts) FROM events) AS now FROM events),
          k AS (SELECT *, status = 'running' AND ts < now - INTERVAL 20 MINUTE AS over FROM j)
          SELECT job_id, CASE WHEN over AND attempts >= 3 THEN 'failed' WHEN over THEN 'queued' ELSE status END AS next_status, CASE WHEN over AND attempts < 3 THEN CASE WHEN attempts <= 1 THEN 30 ELSE 120 END END::BIGINT AS wait_seconds FROM k""")
def z2_lease_recovery(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "view"), "running").when(kind == "error", "failed").otherwise("queued")
    jobs = t.events.select(F.col("event_id").alias("job_id"), status.alias("status"), (F.col("event_id") % 5).alias("attempts"), F.col("ts").alias("leased_at"))
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    return O.leases(jobs.join(F.broadcast(now)), F.col("now")).select("job_id", "next_status", "wait_seconds")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN false WHEN 1 THEN value <= 50 ELSE event_id % 7 < 5 END AS again,
                 [60, 300, 900, 3600, 21600][least(greatest(event_id % 7, 1), 5)]::INTEGER AS delay FROM events WHERE event_type = 'error'""")
def z3_retry_policy(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "permanent").when(F.col("event_id") % 3 == 1, "concurrency").otherwise("transient")
    again, delay = O.retry(kind, F.col("event_id") % 7, F.col("value") > 50)
    return t.events.where("event_type = 'error'").select("event_id", again.alias("again"), delay.alias("delay"))


@query("""WITH r AS (SELECT event_id, user_id, event_type, floor(value / 50)::BIGINT AS finger FROM events)
          SELECT event_id, CASE WHEN event_id = first_value(event_id) OVER w THEN 'new' WHEN finger IS NOT DISTINCT FROM first_value(finger) OVER w THEN 'replay' ELSE 'conflict' END AS outcome
          FROM r WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)""")
def z4_idempotent_requests(t: Tables) -> DataFrame:
    r = t.events.select("event_id", "user_id", "event_type", F.floor(F.col("value") / 50).alias("finger"))
    return O.idempotent(r, ["user_id", "event_type"], ["event_id"], "finger").select("event_id", "outcome")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS recent FROM events")
def z5_rate_windows(t: Tables) -> DataFrame:
    return O.recent(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", 3600).select("event_id", "recent")


@query("""SELECT event_id, event_type, previous FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE event_type IS DISTINCT FROM previous""")
def z6_signature_changes(t: Tables) -> DataFrame:
    return O.changes(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "event_type", "previous")


@query("""SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL""")
def z5_hourly_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n")


MOVES = " OR ".join(f"(kind = '{k}' AND from_state || ':' || to_state IN ({', '.join(map(lit, v))}))" for k, v in O.TRANSITIONS.items())
KINDS, STATES = list(O.TRANSITIONS), ["proposed", "approved", "corrected", "archived"]


@query(f"""WITH c AS (SELECT o_orderkey AS command_id, {KINDS!r}[o_orderkey % 6 + 1] AS kind, {STATES!r}[o_custkey % 4 + 1] AS expected, {STATES!r}[o_custkey % 4 + 1] AS from_state, {STATES!r}[(o_custkey + o_orderkey) % 4 + 1] AS to_state,
                 CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE {STATES!r}[(o_custkey + (o_orderkey % 9 = 0)::INT) % 4 + 1] END AS item_state, o_orderkey % 13 <> 0 AND o_custkey % 21 <> 0 AS owned, o_orderkey % 23 = 0 OR o_custkey % 21 = 0 AS elsewhere, c_acctbal < 0 AS archived, o_orderstatus <> 'P' AS reviewable,
                 o_orderkey % 8 = 0 AS stale, o_orderkey % 17 = 0 AS processed, o_orderkey % 10 <> 0 AS formed, o_orderkey % 19 = 0 AS other_kind FROM orders JOIN customer ON o_custkey = c_custkey)
           SELECT command_id, concat_ws(',', CASE WHEN NOT owned THEN 'project_not_owned' END, CASE WHEN archived THEN 'project_archived' END, CASE WHEN NOT archived AND NOT reviewable THEN 'project_not_reviewable' END,
                  CASE WHEN stale THEN 'stale_revision' END, CASE WHEN processed THEN 'duplicate_command' END, CASE WHEN item_state IS NULL THEN 'item_not_found' END, CASE WHEN item_state IS NOT NULL AND elsewhere THEN 'item_project_mismatch' END, CASE WHEN item_state IS NOT NULL AND other_kind THEN 'item_kind_mismatch' END,
                  CASE WHEN item_state <> expected THEN 'stale_review_state' END, CASE WHEN NOT ({MOVES}) THEN 'invalid_transition' END, CASE WHEN kind = 'correct' AND NOT formed THEN 'invalid_correction' END) AS issues FROM c""")
def x34_review_validation(t: Tables) -> DataFrame:
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("command_id"), pick(KINDS, k).alias("kind"), pick(STATES, u).alias("expected"), pick(STATES, u).alias("from_state"), pick(STATES, u + k).alias("to_state"),
        F.when(u % 11 != 0, pick(STATES, u + (k % 9 == 0).cast("int"))).alias("item_state"), F.when(k % 13 == 0, "someone").otherwise("owner").alias("actor"), F.lit("owner").alias("owner"),
        F.lit("p").alias("project"), F.when(u % 21 == 0, "q").otherwise("p").alias("command_project"), F.when(k % 23 == 0, "r").otherwise("p").alias("item_project"),
        (F.col("c_acctbal") < 0).alias("archived"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("ready").alias("project_status"), F.lit(1).alias("revision"),
        F.when(k % 8 == 0, 0).otherwise(1).alias("client_revision"), (k % 17 == 0).alias("processed"), F.lit("faq").alias("item_kind"), F.when(k % 19 == 0, "entry").otherwise("faq").alias("command_item_kind"),
    )
    return c.select("command_id", O.review_issues(F.col("command_id") % 10 != 0).alias("issues"))


LIVE = ", ".join(f"{R.is_match('low', p)} AS {k}" for k, p in C.PATTERNS.items())
IDENTITY = "left(regexp_replace(low, '[^a-z0-9]+', '_', 'g'), 48)"


@query(f"""WITH u AS (SELECT conv_id, turn, left({R.clean('text')}, {C.CHARS}) AS value FROM conversations WHERE role = 'user'),
           v AS (SELECT *, lower(value) AS low FROM u), m AS (SELECT *, {LIVE}, trim(regexp_extract(value, {lit(C.SUBJECT)}, 1, 'i')) AS subj, trim(regexp_extract(value, {lit(C.SERVICE)}, 1, 'i')) AS serv FROM v),
           r AS (SELECT *, max(CASE WHEN reset THEN turn END) OVER (PARTITION BY conv_id) AS last FROM m),
           k AS (SELECT *, CASE WHEN pause THEN 'paused' WHEN resume THEN 'active' END AS state FROM r)
           SELECT conv_id, coalesce(arg_max(state, turn) FILTER (WHERE alive AND state IS NOT NULL), 'active') AS status, arg_max(subj, turn) FILTER (WHERE alive AND subj <> '') AS subject,
                  arg_max(value, turn) FILTER (WHERE alive AND goal) AS goal, arg_max(serv, turn) FILTER (WHERE alive AND serv <> '') AS service,
                  least(count(DISTINCT value) FILTER (WHERE alive AND regexp_matches(value, '\\?\\s*$')), 20) AS n_follow_ups, least(count(*) FILTER (WHERE alive AND clarification), 12) AS n_clarifications,
                  least(count(*) FILTER (WHERE alive AND context), 12) AS n_context, least(count(DISTINCT {IDENTITY}) FILTER (WHERE alive AND preference), 20) AS n_preferences,
                  least(count(DISTINCT {IDENTITY}) FILTER (WHERE alive AND value <> ''), 40) AS n_details
           FROM (SELECT *, last IS NULL OR turn > last AS alive FROM k) GROUP BY conv_id""")
def x58_conversation_memory(t: Tables) -> DataFrame:
    return C.memory(t.conversations)


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
           g AS (SELECT conv_id, turn, role, left({R.clean('text')}, 180) AS value FROM f WHERE n <= 12),
           s AS (SELECT conv_id, max(turn) AS covered, count(*) AS n_messages, list(value ORDER BY turn) FILTER (WHERE role = 'user') AS said FROM g GROUP BY conv_id)
           SELECT conv_id, covered, n_messages, coalesce(array_to_string(said[-3:], '; '), '') AS updates FROM s""")
def x59_summary_window(t: Tables) -> DataFrame:
    return C.summary(t.conversations)


OLD = "SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS owner FROM orders WHERE o_orderkey % 7 <> 0"
NEW = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 6 = 0 THEN -1 ELSE o_custkey END AS owner FROM orders WHERE o_orderkey % 3 = 0"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    old = t.orders.where(k % 7 != 0).select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    status, owner = F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")), F.when(k % 6 == 0, F.lit(-1)).otherwise(F.col("o_custkey"))
    return old, t.orders.where(k % 3 == 0).select(k.alias("id"), status.alias("status"), owner.alias("owner"))


@query(f"""WITH o AS ({OLD}), n AS ({NEW}) SELECT n.id, n.status, n.owner, CASE WHEN o.id IS NULL THEN 'inserted' WHEN o.status IS NOT DISTINCT FROM n.status AND o.owner IS NOT DISTINCT FROM n.owner THEN 'present' ELSE 'collision' END AS outcome
           FROM n LEFT JOIN o ON o.id = n.id""")
def k1_insert_once(t: Tables) -> DataFrame:
    return writers.insert_once(*_sides(t), ["id"])


@query(f"""WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.owner = n.owner) THEN n.status ELSE o.status END AS status,
           CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.owner = n.owner) THEN n.owner ELSE o.owner END AS owner FROM o FULL JOIN n ON o.id = n.id""")
def k2_guarded_upsert(t: Tables) -> DataFrame:
    return writers.upsert(*_sides(t), ["id"], F.col("old_owner") == F.col("new_owner"))


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT * FROM o WHERE id IN (SELECT id FROM n)")
def k3_keep_submitted(t: Tables) -> DataFrame:
    return writers.keep_submitted(*_sides(t), ["id"])


@query(f"""WITH o AS ({OLD}), n AS ({NEW}) SELECT n.id, n.owner, o.owner AS current, CASE WHEN o.owner IS NULL THEN 'missing' WHEN o.owner = n.owner THEN 'updated' ELSE 'conflict' END AS outcome FROM n LEFT JOIN o ON o.id = n.id""")
def k9_compare_and_set(t: Tables) -> DataFrame:
    old, new = _sides(t)
    return writers.compare_and_set(old, new.select("id", "owner"), "id", "owner")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def s6_json_events(t: Tables) -> DataFrame:
    return readers.json_rows(t.events.select("event_id", "props"), "props", "k long").where("not invalid").select("event_id", "row.k")


@query("SELECT o_orderkey, l_linenumber, l_quantity AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 10")
def s9_recordset(t: Tables) -> DataFrame:
    """Lines of an order as a JSON array, read back as rows with a check."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("qty")))).alias("lines"))
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return readers.recordset(rows, "lines", "l_linenumber int, qty double", ["o_orderkey"], F.col("qty") >= 10)

"""Reviewed knowledge on orders, parts and lines (R3-R5, R7, P18-P24, T3, T5, T8, T15, U3-U6, W10, N6, N8, X3d, X4b, X27, X30, X31, X36, X37, X56, A10, J25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import knowledge as O
from . import registry as R
from .registry import Tables, lit, query

STATES = ["approved", "corrected", "proposed", "archived", "superseded"]
KINDS = [*O.CATEGORIES]
c = F.col


def _pick(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))


def _map_sql(x: str, names: dict[str, str], rest: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in names.items()) + f" ELSE {lit(rest)} END"


ENTRIES = f"""entries AS (SELECT p_partkey AS id, {KINDS!r}[p_partkey % {len(KINDS)} + 1] AS category, {STATES!r}[p_size % 5 + 1] AS status, p_name AS title, p_type AS content, p_size AS score FROM part)"""


def _entries(t: Tables) -> DataFrame:
    return t.part.select(c("p_partkey").alias("id"), _pick(KINDS, c("p_partkey")).alias("category"), _pick(STATES, c("p_size")).alias("status"), c("p_name").alias("title"), c("p_type").alias("content"), c("p_size").alias("score"))


@query(f"WITH {ENTRIES} SELECT id, category, {_map_sql('category', O.REVIEW_CATEGORY, 'business_profile')} AS review_category, {_map_sql('category', O.ENTITY_TYPE, 'general_knowledge')} AS entity_type FROM entries")
def r4_category_mappings(t: Tables) -> DataFrame:
    return _entries(t).select("id", "category", O.mapped(c("category"), O.REVIEW_CATEGORY, "business_profile").alias("review_category"), O.mapped(c("category"), O.ENTITY_TYPE, "general_knowledge").alias("entity_type"))


@query(f"WITH {ENTRIES} SELECT id, category, title, content FROM entries WHERE status IN ('approved', 'corrected') AND id % 6 <> 0")
def r3_website_knowledge(t: Tables) -> DataFrame:
    """Approved or corrected facts of website provenance, by the narrow columns."""
    return _entries(t).where(c("status").isin("approved", "corrected") & (c("id") % 6 != 0)).select("id", "category", "title", "content")


@query("""WITH e AS (SELECT l_orderkey AS fact, l_linenumber AS evidence, l_suppkey % 5 = 0 AS owner, l_partkey % 2 = 0 AS structured, l_shipmode AS url FROM (SELECT *, 'u' || l_partkey % 7 AS l_shipmode FROM lineitem))
          SELECT fact, arg_min({'e': evidence, 'u': url}, (NOT owner, NOT structured, url, evidence)).e AS evidence, arg_min({'e': evidence, 'u': url}, (NOT owner, NOT structured, url, evidence)).u AS url FROM e GROUP BY fact""")
def t8_primary_evidence(t: Tables) -> DataFrame:
    url = F.concat(F.lit("u"), (c("l_partkey") % 7).cast("string"))
    order = F.struct((c("l_suppkey") % 5 != 0).alias("a"), (c("l_partkey") % 2 != 0).alias("b"), url.alias("url"), c("l_linenumber").alias("evidence"))
    return t.lineitem.groupBy(c("l_orderkey").alias("fact")).agg(F.min(order).alias("top")).select("fact", "top.evidence", "top.url")


@query("""WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS block, l_returnflag || ' ' || l_linestatus || ' ' || l_suppkey AS text FROM lineitem), e AS (SELECT o_orderkey AS doc, o_orderstatus || ' ' || o_custkey % 10 AS excerpt FROM orders)
          SELECT e.doc, excerpt, min(block) AS block FROM e LEFT JOIN b ON b.doc = e.doc AND contains(b.text, e.excerpt) GROUP BY ALL""")
def r7_evidence_locations(t: Tables) -> DataFrame:
    blocks = t.lineitem.select(c("l_orderkey").alias("doc"), c("l_linenumber").alias("block"), F.concat_ws(" ", "l_returnflag", "l_linestatus", c("l_suppkey").cast("string")).alias("text"))
    found = t.orders.select(c("o_orderkey").alias("doc"), F.concat_ws(" ", "o_orderstatus", (c("o_custkey") % 10).cast("string")).alias("excerpt"))
    held = found.join(blocks, "doc").where(c("text").contains(c("excerpt"))).groupBy("doc").agg(F.min("block").alias("block"))
    return found.join(held, "doc", "left").select("doc", "excerpt", "block")


SAID = ["ok", "Thanks!", "Hold on...", "  no ", "a plan for the team", "hmm?"]


@query(f"""WITH m AS (SELECT conv_id, turn, {R.clean(f"CASE WHEN turn % 2 = 0 THEN {SAID!r}[(coalesce(conv_id, 0) + coalesce(turn, 0)) % {len(SAID)} + 1] ELSE text END")} AS v FROM conversations)
           SELECT conv_id, turn, length(v) < 4 OR regexp_matches(lower(v), {lit(O.LOW_SIGNAL)}) AS low_signal FROM m""")
def p20_low_signal(t: Tables) -> DataFrame:
    text = F.when(c("turn") % 2 == 0, _pick(SAID, F.coalesce("conv_id", F.lit(0)) + F.coalesce("turn", F.lit(0)))).otherwise(c("text"))
    return t.conversations.select("conv_id", "turn", O.low_signal(text).alias("low_signal"))


@query("""SELECT o_custkey AS project, count(*) FILTER (WHERE o_orderstatus <> 'F') AS canonical, count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderstatus <> 'F') AS projected, count(DISTINCT o_orderpriority) > 4 AS mixed,
          count(*) FILTER (WHERE o_orderstatus <> 'F') = count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderstatus <> 'F') AND NOT count(DISTINCT o_orderpriority) > 4 AND max(o_orderkey) % 3 = min(o_orderkey) % 3 AS fresh FROM orders GROUP BY 1""")
def p22_projection_fresh(t: Tables) -> DataFrame:
    live = c("o_orderstatus") != "F"
    out = t.orders.groupBy(c("o_custkey").alias("project")).agg(
        F.count_if(live).alias("canonical"), F.count_if(live & (c("o_orderkey") % 5 != 0)).alias("projected"), (F.countDistinct("o_orderpriority") > 4).alias("mixed"),
        (F.max("o_orderkey") % 3 == F.min("o_orderkey") % 3).alias("same"),
    )
    return out.select("project", "canonical", "projected", "mixed", ((c("canonical") == c("projected")) & ~c("mixed") & c("same")).alias("fresh"))


CUT = """x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'legacy' ELSE 'canonical' END AS authority, o_orderkey % 5 <> 0 AS has_evidence, CASE WHEN o_orderkey % 11 = 0 THEN 'MINOR' ELSE 'MATCH' END AS parity,
          CASE WHEN o_custkey % 13 = 0 THEN 'legacy' ELSE 'canonical' END AS evidence_authority, CASE WHEN o_custkey % 9 = 0 THEN 'rebuilding' ELSE 'valid' END AS state, CASE WHEN o_custkey % 8 = 0 THEN 2 ELSE 1 END AS evidence_version, 1 AS version,
          1 AS evidence_schema, CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS schema_, CASE WHEN o_custkey % 15 = 0 THEN '' WHEN o_custkey % 14 = 0 THEN NULL ELSE o_orderstatus END AS evidence_fingerprint,
          CASE WHEN o_orderkey % 19 = 0 THEN 'Z' ELSE o_orderstatus END AS fingerprint, o_orderdate AS compared, CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS generated FROM orders)"""
UNAVAILABLE = "assistant_projection_runtime_unavailable_"


def _cut(t: Tables) -> DataFrame:
    k, u = c("o_orderkey"), c("o_custkey")
    return t.orders.select(
        k.alias("k"), F.when(k % 7 == 0, "legacy").otherwise("canonical").alias("authority"), (k % 5 != 0).alias("has_evidence"), F.when(k % 11 == 0, "MINOR").otherwise("MATCH").alias("parity"),
        F.when(u % 13 == 0, "legacy").otherwise("canonical").alias("evidence_authority"), F.when(u % 9 == 0, "rebuilding").otherwise("valid").alias("state"), F.when(u % 8 == 0, 2).otherwise(1).alias("evidence_version"),
        F.lit(1).alias("version"), F.lit(1).alias("evidence_schema"), F.when(k % 17 == 0, 2).otherwise(1).alias("schema"), F.when(u % 15 == 0, "").when(u % 14 == 0, None).otherwise(c("o_orderstatus")).alias("evidence_fingerprint"),
        F.when(k % 19 == 0, "Z").otherwise(c("o_orderstatus")).alias("fingerprint"), c("o_orderdate").alias("compared"), F.when(k % 6 == 0, c("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(c("o_orderdate")).alias("generated"),
    )


@query(f"""WITH {CUT} SELECT k, CASE WHEN authority <> 'canonical' THEN 'assistant_projection_migration_required' WHEN NOT has_evidence THEN '{UNAVAILABLE}parity_evidence_unavailable' WHEN parity <> 'MATCH' THEN '{UNAVAILABLE}parity_status_unacceptable'
           WHEN evidence_authority <> authority THEN '{UNAVAILABLE}parity_authority_mismatch' WHEN state <> 'valid' THEN '{UNAVAILABLE}' || state WHEN evidence_version <> version OR evidence_schema <> schema_ THEN '{UNAVAILABLE}parity_evidence_stale'
           WHEN coalesce(evidence_fingerprint, '') = '' OR evidence_fingerprint <> fingerprint THEN '{UNAVAILABLE}parity_evidence_fingerprint_mismatch' WHEN compared < generated THEN '{UNAVAILABLE}parity_evidence_stale' END AS failure FROM x""")
def p23_cutover(t: Tables) -> DataFrame:
    return _cut(t).select("k", O.cutover_failure().alias("failure"))


@query(f"""WITH {CUT} SELECT k, CASE WHEN NOT has_evidence THEN 'missing' WHEN reasons = '' THEN 'current' ELSE 'stale' END AS status, CASE WHEN has_evidence THEN reasons END AS reasons FROM (SELECT *, concat_ws(',',
           CASE WHEN evidence_fingerprint IS DISTINCT FROM fingerprint THEN 'fingerprint_mismatch' END, CASE WHEN evidence_version <> 1 THEN 'projection_version_mismatch' END, CASE WHEN schema_ <> 1 THEN 'schema_version_mismatch' END,
           CASE WHEN state <> 'valid' THEN 'invalidation_state' END) AS reasons FROM x)""")
def x37_projection_freshness(t: Tables) -> DataFrame:
    x = _cut(t).select("k", "has_evidence", c("evidence_fingerprint").alias("r_fingerprint"), c("evidence_version").alias("r_version"), c("schema").alias("r_schema"), c("state").alias("r_state"), c("fingerprint").alias("n_fingerprint"))
    x = x.withColumn("reasons", O.stale_reasons("r_", "n_"))
    return x.select("k", F.when(~c("has_evidence"), "missing").when(c("reasons") == "", "current").otherwise("stale").alias("status"), F.when(c("has_evidence"), c("reasons")).alias("reasons"))


@query("SELECT o_custkey AS project, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS attempt, max(o_orderdate) AS captured FROM orders GROUP BY 1")
def w10_latest_attempt(t: Tables) -> DataFrame:
    return t.orders.groupBy(c("o_custkey").alias("project")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("top")).select("project", c("top.o_orderkey").alias("attempt"), c("top.o_orderdate").alias("captured"))


@query(f"WITH {ENTRIES} SELECT status, id, category, title, row_number() OVER (PARTITION BY status ORDER BY category, lower(title), title, id) AS place FROM entries")
def t15_category_then_title(t: Tables) -> DataFrame:
    return _entries(t).select("status", "id", "category", "title", F.row_number().over(W.partitionBy("status").orderBy("category", F.lower("title"), "title", "id")).alias("place"))


@query("""WITH u AS (SELECT l_suppkey AS question, l_partkey AS evidence, count(*) AS uses, max(l_shipdate) AS captured, bool_or(l_returnflag = 'R') AS has_excerpt FROM lineitem GROUP BY 1, 2)
          SELECT question, evidence, uses, n FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY uses DESC, captured DESC, has_excerpt DESC, evidence) AS n FROM u) WHERE n <= 12""")
def t3_best_evidence(t: Tables) -> DataFrame:
    used = t.lineitem.groupBy(c("l_suppkey").alias("question"), c("l_partkey").alias("evidence")).agg(F.count("*").alias("uses"), F.max("l_shipdate").alias("captured"), F.bool_or(c("l_returnflag") == "R").alias("has_excerpt"))
    return O.best_evidence(used, ["question"], 12).select("question", "evidence", "uses", "n")


@query("""WITH f AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS part, unnest(range(len(string_split(p_name || ' ' || p_type, ' ')))) AS pos FROM part)
          SELECT p_partkey, arg_min(part, (-length(part), pos)) AS best FROM f GROUP BY 1""")
def t5_best_fragment(t: Tables) -> DataFrame:
    """T5: of a value's fragments the one of best score (here its length), the first of several."""
    parts = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    ranked = F.transform(parts, lambda x, i: F.struct((-F.length(x)).alias("score"), i.alias("at"), x.alias("part")))
    return t.part.select("p_partkey", F.array_min(ranked)["part"].alias("best"))


@query("""SELECT origin, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT 'owner' AS origin, c_custkey AS id FROM customer UNION ALL SELECT 'website', o_custkey FROM orders UNION ALL SELECT 'faq', s_suppkey FROM supplier UNION ALL
          SELECT 'recovered', o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def u3_candidate_union(t: Tables) -> DataFrame:
    own = lambda df, key, name: df.select(F.lit(name).alias("origin"), c(key).alias("id"))
    every = own(t.customer, "c_custkey", "owner").unionByName(own(t.orders, "o_custkey", "website")).unionByName(own(t.supplier, "s_suppkey", "faq"))
    every = every.unionByName(own(t.orders.where("o_orderstatus = 'P'"), "o_custkey", "recovered"))
    return every.groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


SETS = """a AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 9)) AS x FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 9)) AS y FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1),
          j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b ON a.k = b.k)"""


@query(f"""WITH {SETS} SELECT k, array_to_string(list_sort(list_distinct(x || y)), ',') AS keys, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), ',') AS added, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), ',') AS removed FROM j""")
def u4_evidence_sets(t: Tables) -> DataFrame:
    """The sorted union of two key sets, and what each lacks of the other."""
    side = lambda where, name: t.lineitem.where(where).groupBy(c("l_orderkey").alias("k")).agg(F.sort_array(F.collect_set(c("l_suppkey") % 9)).alias(name))
    none = F.array().cast("array<bigint>")
    j = side("l_linenumber <= 3", "x").join(side("l_linenumber >= 3", "y"), "k", "full").select("k", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    return j.select("k", F.array_join(F.sort_array(F.array_union("x", "y")), ",").alias("keys"), F.array_join(F.array_except("y", "x"), ",").alias("added"), F.array_join(F.array_except("x", "y"), ",").alias("removed"))


@query(f"SELECT p_partkey, lower({R.clean('p_name')}) AS entity_name FROM part")
def n6_entity_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", O.entity_name(c("p_name")).alias("entity_name"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(0), ''), chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')) AS digest FROM documents""")
def n8_research_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(O.research_text(c("text")).cast("binary")).alias("digest"))


PATH = "coalesce(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '')"
TITLE = "coalesce(regexp_extract(html, '<title>([^<]*)', 1), '')"


@query(f"SELECT page_id, CASE {' '.join(f'WHEN regexp_matches(v, {lit(p)}) THEN {lit(n)}' for n, p in O.PAGE_TYPES)} WHEN path IN ('/', '') THEN 'home' ELSE 'other' END AS page_type FROM (SELECT page_id, {PATH} AS path, lower({PATH} || ' ' || {TITLE}) AS v FROM pages)")
def x3d_page_types(t: Tables) -> DataFrame:
    path = F.coalesce(F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1), F.lit(""))
    return t.pages.select("page_id", O.page_type(path, F.coalesce(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(""))).alias("page_type"))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 OR bool_or(value < 0) THEN 'partial' ELSE 'completed' END AS status, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1""")
def x4b_crawl_status(t: Tables) -> DataFrame:
    failures = F.count_if(c("event_type") == "error")
    return t.events.groupBy("user_id").agg(F.when((failures > 0) | F.coalesce(F.bool_or(c("value") < 0), F.lit(False)), "partial").otherwise("completed").alias("status"), failures.alias("failures"))


@query(f"""WITH cur AS (SELECT o_orderkey AS id, {STATES!r}[o_custkey % 5 + 1] AS status, o_orderpriority AS content FROM orders WHERE o_orderkey % 4 <> 0),
           inc AS (SELECT o_orderkey AS id, {STATES!r}[(o_custkey + (o_orderkey % 6 = 0)::INT) % 5 + 1] AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS content FROM orders WHERE o_orderkey % 3 <> 0),
           j AS (SELECT inc.*, cur.id IS NOT NULL AS known, cur.status AS old, CASE WHEN inc.status NOT IN ('approved', 'corrected', 'archived') THEN 'skipped' WHEN cur.id IS NULL THEN 'added'
                 WHEN inc.status = cur.status AND inc.content IS NOT DISTINCT FROM cur.content THEN 'skipped' ELSE 'updated' END AS change FROM inc LEFT JOIN cur ON cur.id = inc.id)
           SELECT id, change, change <> 'skipped' AND status = 'archived' AND NOT (known AND old = 'archived') AS archives FROM j""")
def x27_entry_merge(t: Tables) -> DataFrame:
    k, u = c("o_orderkey"), c("o_custkey")
    cur = t.orders.where("o_orderkey % 4 <> 0").select(k.alias("id"), _pick(STATES, u).alias("status"), c("o_orderpriority").alias("content"))
    inc = t.orders.where("o_orderkey % 3 <> 0").select(k.alias("id"), _pick(STATES, u + (k % 6 == 0).cast("int")).alias("status"), F.when(k % 5 != 0, c("o_orderpriority")).alias("content"))
    return O.merge_entries(cur, inc, "id", ["status", "content"])


SOURCES, SAVED = ["website", "manual_intake", "generated_qa", "user_edit", "imported_data"], ["manual", "website", "ai_generated", "user_corrected"]
PROVENANCE = f"""e AS (SELECT p_partkey AS id, {STATES!r}[p_size % 5 + 1] AS status, {SOURCES!r}[p_partkey % 5 + 1] AS source, CASE WHEN p_partkey % 3 = 0 THEN 'intake' ELSE 'website_knowledge' END AS block, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS url,
                 CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type END AS excerpt, p_partkey % 4 = 0 AS generated, p_partkey % 13 = 0 AS edited, CASE WHEN p_partkey % 6 = 0 THEN {SAVED!r}[p_size % 4 + 1] WHEN p_partkey % 17 = 0 THEN 'odd' END AS saved FROM part),
                 k AS (SELECT *, CASE WHEN saved IN ('manual', 'website', 'ai_generated', 'user_corrected') THEN saved WHEN status = 'corrected' OR source = 'user_edit' OR edited THEN 'user_corrected'
                       WHEN source = 'website' AND block = 'website_knowledge' AND coalesce(url, '') <> '' AND coalesce(excerpt, '') <> '' THEN 'website' WHEN generated OR source = 'generated_qa' THEN 'ai_generated' WHEN source = 'manual_intake' THEN 'manual' ELSE 'ai_generated' END AS origin FROM e)"""


def _provenance(t: Tables) -> DataFrame:
    k, size = c("p_partkey"), c("p_size")
    saved = F.when(k % 6 == 0, _pick(SAVED, size)).when(k % 17 == 0, "odd")
    return t.part.select(k.alias("id"), O.provenance(
        _pick(STATES, size), _pick(SOURCES, k), F.when(k % 3 == 0, "intake").otherwise("website_knowledge"), F.when(k % 7 != 0, c("p_brand")),
        F.when(k % 11 == 0, "").otherwise(c("p_type")), k % 4 == 0, k % 13 == 0, saved).alias("origin"))


@query(f"WITH {PROVENANCE} SELECT id, origin FROM k")
def x30_provenance(t: Tables) -> DataFrame:
    return _provenance(t)


@query(f"""WITH {PROVENANCE}, n AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS sources, count(*) FILTER (WHERE l_returnflag = 'R') AS evidence FROM lineitem WHERE l_linenumber = 7 GROUP BY 1)
           SELECT origin, CASE WHEN origin = 'website' AND coalesce(sources, 0) > 0 AND coalesce(evidence, 0) > 0 THEN 'exact' WHEN coalesce(sources, 0) > 0 OR coalesce(evidence, 0) > 0 THEN 'partial' ELSE 'classification_only' END AS availability, count(*) AS n
           FROM k LEFT JOIN n USING (id) GROUP BY ALL""")
def x31_provenance_summary(t: Tables) -> DataFrame:
    n = t.lineitem.where("l_linenumber = 7").groupBy(c("l_partkey").alias("id")).agg(F.countDistinct("l_suppkey").alias("sources"), F.count_if(c("l_returnflag") == "R").alias("evidence"))
    both = _provenance(t).join(n, "id", "left").fillna(0, ["sources", "evidence"])
    return both.groupBy("origin", O.availability(c("origin") == "website", c("sources"), c("evidence")).alias("availability")).agg(F.count("*").alias("n"))


MEMORY = f"""a AS (SELECT o_custkey AS project, o_orderkey AS id, o_custkey * 10 + o_orderkey % 4 AS entity, {STATES!r}[o_orderkey % 5 + 1] AS state, o_orderpriority AS value,
                   CASE WHEN o_orderkey % 31 = 0 THEN -1 WHEN o_orderkey % 101 = 0 THEN o_orderkey WHEN o_orderkey % 6 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS predecessor FROM orders),
             l AS (SELECT a.*, p.state AS before FROM a LEFT JOIN a p ON p.project = a.project AND p.id = a.predecessor WHERE a.predecessor IS NOT NULL),
             u AS (SELECT project FROM a WHERE predecessor = id UNION ALL SELECT project FROM l WHERE before IS NULL OR (state = 'corrected' AND before NOT IN ('approved', 'corrected', 'superseded', 'archived')) UNION ALL
                   SELECT project FROM l GROUP BY project, predecessor HAVING count(*) FILTER (WHERE state IN ('approved', 'corrected')) > 1 OR (bool_or(state IN ('approved', 'corrected', 'proposed')) AND min(before) IN ('approved', 'corrected'))),
             r AS (SELECT project, min(code) AS code FROM (SELECT c_custkey AS project, 'assistant_projection_unresolved_conflict' AS code FROM customer WHERE c_acctbal < 0 UNION ALL SELECT project, 'assistant_projection_unresolved_revision_authority' FROM u) GROUP BY 1)"""


def _memory(t: Tables) -> tuple[DataFrame, DataFrame]:
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    a = t.orders.select(
        c("o_custkey").alias("project"), c("o_orderkey").alias("id"), (c("o_custkey") * 10 + c("o_orderkey") % 4).alias("entity"), _pick(STATES, c("o_orderkey")).alias("state"), c("o_orderpriority").alias("value"),
        F.when(c("o_orderkey") % 31 == 0, F.lit(-1)).when(c("o_orderkey") % 101 == 0, c("o_orderkey")).when(c("o_orderkey") % 6 == 0, before).alias("predecessor"),
    )
    return a, t.customer.select(c("c_custkey").alias("project"), (c("c_acctbal") >= 0).alias("resolved"))


@query(f"WITH {MEMORY} SELECT project, code FROM r")
def x36_projection_refusals(t: Tables) -> DataFrame:
    return O.refusals(*_memory(t))


@query(f"""WITH {MEMORY} SELECT project, id, CASE entity % 10 WHEN 3 THEN entity - 3 WHEN 2 THEN entity - 2 ELSE entity END AS entity, CASE WHEN entity % 2 = 0 THEN 'service' ELSE 'product' END AS type, 'e' || entity AS title, value, state, predecessor
           FROM a WHERE state IN ('approved', 'corrected') AND project NOT IN (SELECT project FROM r) AND NOT (project % 13 = 0 AND entity % 10 IN (0, 2, 3))""")
def x36_serving_projection(t: Tables) -> DataFrame:
    a, conflicts = _memory(t)
    entities = a.select("project", "entity").distinct().withColumns({"type": F.when(c("entity") % 2 == 0, "service").otherwise("product"), "name": F.concat(F.lit("e"), c("entity").cast("string"))})
    merges = t.customer.select(F.explode(F.array(F.struct((c("c_custkey") * 10 + 3).alias("src"), (c("c_custkey") * 10 + 2).alias("dst")), F.struct((c("c_custkey") * 10 + 2).alias("src"), (c("c_custkey") * 10).alias("dst")), F.when(c("c_custkey") % 13 == 0, F.struct((c("c_custkey") * 10).alias("src"), (c("c_custkey") * 10 + 3).alias("dst"))))).alias("m")).where("m is not null").select("m.*")
    return O.projection(a, entities, merges, conflicts)


TOLD = ["We offer repairs and they are included.", "Repairs cost extra.", "The shop is closed, 5 days a week.", "The shop is open 6 days a week.", "Deliveries are not available.", "Delivery is available at 20.", "Nothing of note."]
ITEM_KINDS = [*O.FACTUAL, "preference"]


def _words_sql(x: str) -> str:
    return R.tokens(x, 3)


def _signs_sql(x: str) -> str:
    m = lambda p: R.is_match(x, p)
    return f"""list_filter([CASE WHEN {m(O.UNAVAILABLE)} THEN '-available' WHEN {m(O.AVAILABLE)} THEN '+available' END, CASE WHEN {m(chr(92) + 'bclosed' + chr(92) + 'b')} THEN '-open' END, CASE WHEN {m(chr(92) + 'bopen' + chr(92) + 'b')} THEN '+open' END,
               CASE WHEN {m(O.EXTRA)} THEN '-included' WHEN {m(O.INCLUDED)} THEN '+included' END], lambda s: s IS NOT NULL)"""


TERMS = lambda x: f"list_distinct(list_transform({_words_sql(x)}, lambda w: regexp_replace(regexp_replace(w, 'ies$', 'y'), 's$', '')))"
NUMS = lambda x: f"regexp_extract_all({x}, '\\d+(?:\\.\\d+)?')"


@query(f"""WITH i AS (SELECT o_orderkey AS item_id, o_custkey AS thread, {ITEM_KINDS!r}[o_orderkey % {len(ITEM_KINDS)} + 1] AS category, {TOLD!r}[o_orderkey % {len(TOLD)} + 1] AS content FROM orders),
           f AS (SELECT c_custkey AS thread, {TOLD!r}[c_custkey % {len(TOLD)} + 1] AS value FROM customer)
           SELECT DISTINCT i.thread, item_id FROM i JOIN f ON i.thread = f.thread WHERE
           (len({NUMS('content')}) > 0 AND len({NUMS('value')}) > 0 AND len(list_filter({NUMS('content')}, lambda n: NOT list_contains({NUMS('value')}, n))) > 0 AND list_has_any({_words_sql('content')}, {_words_sql('value')}))
           OR (category <> 'preference' AND list_has_any({TERMS('content')}, {TERMS('value')}) AND list_has_any({_signs_sql('content')}, list_transform({_signs_sql('value')}, lambda s: CASE WHEN s[1] = '-' THEN '+' ELSE '-' END || substr(s, 2))))""")
def x56_contradicted_memory(t: Tables) -> DataFrame:
    items = t.orders.select(c("o_orderkey").alias("item_id"), c("o_custkey").alias("thread"), _pick(ITEM_KINDS, c("o_orderkey")).alias("category"), _pick(TOLD, c("o_orderkey")).alias("content"))
    return O.contradicted(items, t.customer.select(c("c_custkey").alias("thread"), _pick(TOLD, c("c_custkey")).alias("value")))


@query(f"""WITH {ENTRIES} SELECT category, count(*) AS n, avg(score) AS mean, count(*) FILTER (WHERE status IN ('approved', 'corrected')) / count(*) AS approved, bool_or(status = 'proposed') AS has_open FROM entries GROUP BY 1""")
def a10_diagnostics(t: Tables) -> DataFrame:
    live = c("status").isin("approved", "corrected")
    return _entries(t).groupBy("category").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), (F.count_if(live) / F.count("*")).alias("approved"), F.bool_or(c("status") == "proposed").alias("has_open"))


@query("""WITH s AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders WHERE o_orderstatus = 'O')
          SELECT o.o_orderkey, coalesce(seq, 0) AS sequence FROM orders o LEFT JOIN s ON s.o_orderkey = o.o_orderkey""")
def j25_backfilled_sequence(t: Tables) -> DataFrame:
    """Rows take a number computed for some of them; the others keep theirs."""
    s = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("seq"))
    return t.orders.select("o_orderkey").join(s, "o_orderkey", "left").select("o_orderkey", F.coalesce("seq", F.lit(0)).alias("sequence"))

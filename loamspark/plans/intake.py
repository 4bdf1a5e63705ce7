"""Intake and packs on parts, customers and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import intake as O
from . import registry as R
from .registry import Tables, lit, query

KINDS = [*O.QUESTIONS, "faq", *O.SECTIONS]
STATES = ["approved", "corrected", "proposed", "archived"]
c = F.col
text = lambda x: c(x).cast("string")


def _pick(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))


def _parts(t: Tables) -> DataFrame:
    """Parts as facts of sessions; their names repeat with the brand as title."""
    title = F.when(c("p_partkey") % 11 == 0, "").otherwise(F.concat_ws(" ", "p_brand", "p_type"))
    return t.part.select(
        (c("p_size") % 5).cast("long").alias("session"), c("p_partkey").cast("long").alias("ordinal"), text("p_partkey").alias("fact_id"), _pick(KINDS, c("p_partkey")).alias("category"),
        title.alias("title"), c("p_name").alias("content"), (c("p_size") / 50).alias("score"), _pick(STATES, c("p_size")).alias("status"),
    )


PARTS = f"""parts AS (SELECT (p_size % 5)::BIGINT AS session, p_partkey::BIGINT AS ordinal, p_partkey::VARCHAR AS fact_id, {KINDS!r}[p_partkey % {len(KINDS)} + 1] AS category,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand || ' ' || p_type END AS title, p_name AS content, p_size / 50 AS score, {STATES!r}[p_size % {len(STATES)} + 1] AS status FROM part)"""
FORMS = " ".join(f"WHEN {lit(k)} THEN replace({lit(v)}, '{{}}', {R.clean('''coalesce(nullif(title, ''), content)''')})" for k, v in O.QUESTIONS.items())
COMPARABLE = f"""trim(regexp_replace(regexp_replace(regexp_replace(lower({R.clean('question')}), '[“”"''`]', '', 'g'), '[^a-z0-9$%./:\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query(f"""WITH {PARTS}, q AS (SELECT *, CASE category {FORMS} END AS question FROM parts), k AS (SELECT *, row_number() OVER (PARTITION BY session, {COMPARABLE} ORDER BY ordinal) AS n FROM q WHERE question IS NOT NULL)
           SELECT session, 'generated_faq_' || lower(to_hex({R.fnv("(question || ':' || fact_id)")})) AS faq_id, fact_id, question, content AS answer,
                  CASE WHEN score >= 0.82 THEN 'high' WHEN score >= 0.58 THEN 'medium' ELSE 'low' END AS confidence FROM k WHERE n = 1""")
def x18_faq_candidates(t: Tables) -> DataFrame:
    return O.faq_candidates(_parts(t))


def _entries(t: Tables) -> DataFrame:
    """Customers as entries: a third by the plain id of a part, a third by its scoped id, a third by hand."""
    k, project = c("c_custkey"), (c("c_custkey") % 4).cast("long")
    own = F.when(k % 3 == 0, F.concat(F.lit("f"), text("c_custkey"))).when(k % 3 == 1, F.concat(project.cast("string"), F.lit(":f"), text("c_custkey"))).otherwise(F.concat(F.lit("m"), text("c_custkey")))
    return t.customer.select(project.alias("project"), own.alias("entry_id"), _pick(KINDS, k).alias("category"), _pick(STATES, k + c("c_nationkey")).alias("status"))


def _reconciled(t: Tables) -> DataFrame:
    project = (c("p_partkey") % 4).cast("long")
    facts = t.part.select(project.alias("project"), F.concat(project.cast("string"), F.lit(":f"), text("p_partkey")).alias("scoped_id"), F.concat(F.lit("f"), text("p_partkey")).alias("plain_id"), _pick(KINDS, c("p_size")).alias("category"))
    return O.reconcile(_entries(t), facts)


RECONCILED = f"""entries AS (SELECT c_custkey % 4 AS project, CASE c_custkey % 3 WHEN 0 THEN 'f' || c_custkey WHEN 1 THEN c_custkey % 4 || ':f' || c_custkey ELSE 'm' || c_custkey END AS entry_id,
        {KINDS!r}[c_custkey % {len(KINDS)} + 1] AS category, {STATES!r}[(c_custkey + c_nationkey) % {len(STATES)} + 1] AS status FROM customer),
    fresh AS (SELECT p_partkey % 4 AS project, p_partkey % 4 || ':f' || p_partkey AS entry_id, {KINDS!r}[p_size % {len(KINDS)} + 1] AS category FROM part p
        WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.project = p_partkey % 4 AND e.entry_id IN (p_partkey % 4 || ':f' || p_partkey, 'f' || p_partkey))),
    reconciled AS (SELECT project::BIGINT AS project, entry_id, category, status, false AS added FROM entries UNION ALL SELECT project::BIGINT, entry_id, category, 'proposed', true FROM fresh)"""


@query(f"WITH {RECONCILED} SELECT * FROM reconciled")
def x26_reconciled_entries(t: Tables) -> DataFrame:
    return _reconciled(t)


@query(f"""WITH {RECONCILED}, faqs AS (SELECT o_custkey % 4 AS project, 'm' || o_custkey AS entry_id, o_orderkey AS faq_id, {STATES!r}[o_orderkey % {len(STATES)} + 1] AS status FROM orders WHERE o_orderpriority = '1-URGENT'),
           both_kinds AS (SELECT project, status FROM reconciled r WHERE NOT EXISTS (SELECT 1 FROM faqs f WHERE f.project = r.project AND f.entry_id = r.entry_id) UNION ALL SELECT project, status FROM faqs)
           SELECT project::BIGINT AS project, count(*) AS total, count(*) FILTER (WHERE status IN ('approved', 'corrected')) AS approved, count(*) FILTER (WHERE status = 'proposed') AS proposed, count(*) FILTER (WHERE status = 'archived') AS archived
           FROM both_kinds GROUP BY ALL""")
def x26_review_counts(t: Tables) -> DataFrame:
    faqs = t.orders.where("o_orderpriority = '1-URGENT'").select((c("o_custkey") % 4).cast("long").alias("project"), F.concat(F.lit("m"), text("o_custkey")).alias("entry_id"), c("o_orderkey").alias("faq_id"), _pick(STATES, c("o_orderkey")).alias("status"))
    return O.review_counts(_reconciled(t), faqs)


@query(f"""WITH {PARTS}, rows AS (
               SELECT session, CASE category WHEN 'behavior_rule' THEN 'behavior_rules' WHEN 'prohibited_claim' THEN 'prohibited_claims' ELSE 'facts' END AS section, 'knowledge_' || fact_id AS item_id, category,
                      {R.clean('title')} AS name, {R.clean('content')} AS content FROM parts WHERE status IN ('approved', 'corrected')
               UNION ALL SELECT s_nationkey % 5, 'faq', 'knowledge_' || s_suppkey, '', {R.clean('s_name')}, {R.clean('s_name')} FROM supplier WHERE s_suppkey % 4 < 2)
           SELECT *, row_number() OVER (PARTITION BY session, section ORDER BY category, name, item_id) AS place FROM rows""")
def x62_knowledge_pack(t: Tables) -> DataFrame:
    faqs = t.supplier.select((c("s_nationkey") % 5).cast("long").alias("session"), text("s_suppkey").alias("faq_id"), c("s_name").alias("question"), c("s_name").alias("answer"), _pick(STATES, c("s_suppkey")).alias("status"))
    pack = O.knowledge_pack(_parts(t).withColumnRenamed("fact_id", "entry_id"), faqs)
    return pack.withColumn("place", c("place").cast("long"))


PLACES = ["/docs/price-list.pdf", "/files/report.pdf", "/blog/pricing.pdf", "/get?file=Product%20Guide.PDF", "/get?id=7", "/menus/index.html"]
SAID = ["", "our services as PDF", "press release (pdf)", "download"]


@query(f"""WITH u AS (SELECT p_partkey AS id, 'https://' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '.example.com' || {PLACES!r}[p_partkey % {len(PLACES)} + 1] AS url, {SAID!r}[p_size % {len(SAID)} + 1] AS said FROM part),
           v AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, replace(regexp_extract(url, '=(.*)$', 1), '%20', ' ') AS val FROM u),
           e AS (SELECT *, regexp_replace(path, '[/.]+', ' ', 'g') || ' ' || val || ' ' || said AS ev FROM v)
           SELECT id, url, said, (regexp_matches(path, '(?i)\\.pdf$') OR regexp_matches(val, '(?i)\\.pdf$') OR (regexp_matches(said, '(?i)\\bpdf\\b') AND regexp_matches(said, {lit(O.PDF_DURABLE)})))
                  AND regexp_matches(ev, {lit(O.PDF_DURABLE)}) AND NOT regexp_matches(ev, {lit(O.PDF_EDITORIAL)}) AS eligible FROM e""")
def p11_eligible_pdfs(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit(".example.com"), _pick(PLACES, c("p_partkey")))
    own = t.part.select(c("p_partkey").alias("id"), url.alias("url"), _pick(SAID, c("p_size")).alias("said"))
    return own.withColumn("eligible", O.eligible_pdf(c("url"), c("said")))

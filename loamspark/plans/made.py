"""Conflicts and FAQs on made texts, where the given tables have none (X11, A3, T6, X11e, W6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as K
from ..operators import facts as O
from . import registry as R
from .registry import Tables, lit, query

c = F.col
VALUES = ["Costs $10 a month", "A month costs $ 10", "Costs $12 per month", "Returned within 30 days", "Within 14 days, or 30 days", "Write to help@shop.example now", "Ask us", "ask  us!"]


def _pick(values: list[str], key) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


@query(f"""WITH f AS (SELECT o_custkey AS site, o_orderkey AS fact_id, 'topic:' || o_orderkey % 3 AS topic_key, {VALUES!r}[o_orderkey // 8 % {len(VALUES)} + 1] AS v, CASE WHEN o_orderkey % 5 = 0 THEN 'owner' ELSE 'website' END AS provenance FROM orders),
           m AS (SELECT *, coalesce(nullif(array_to_string(list_sort(regexp_extract_all({R.key('v')}, {lit(K.MATERIAL)})), '|'), ''), {R.key('v')}) AS m FROM f)
           SELECT site, topic_key, count(*) AS n, count(DISTINCT m) AS n_values, arg_min(fact_id, (provenance <> 'owner', fact_id)) AS preferred, bool_or(provenance = 'owner') AS with_owner FROM m GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT m) >= 2""")
def x11_made_conflicts(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    facts = t.orders.select(
        c("o_custkey").alias("site"), k.alias("fact_id"), F.concat(F.lit("topic:"), (k % 3).cast("string")).alias("topic_key"), _pick(VALUES, F.floor(k / 8)).alias("value"), F.when(k % 5 == 0, "owner").otherwise("website").alias("provenance"),
    )
    return O.conflicts(facts)


KINDS = ["paragraph", "faq_question", "faq_answer", "heading", "list_item", "paragraph", "heading", "table"]
TEXTS = ["An answer here.", "Is it open?", "Yes it is.", "Other things", "an item", "What then?", "Do you ship?", "1 2"]
_STOP = "(type = 'faq_question' OR (type = 'heading' AND ends_with(text, '?')))"


@query(f"""WITH b AS (SELECT l_partkey % 40 AS site, l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ordinal, {KINDS!r}[(l_partkey + l_suppkey) % {len(KINDS)} + 1] AS type, {TEXTS!r}[(l_partkey + l_suppkey + CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 4 ELSE 0 END) % {len(TEXTS)} + 1] AS text,
                     CASE WHEN l_orderkey % 3 = 0 THEN 'faq' ELSE 'page' END AS page_type FROM lineitem),
           q AS (SELECT * FROM b WHERE type = 'faq_question' OR (ends_with(text, '?') AND (page_type = 'faq' OR type = 'heading'))),
           a AS (SELECT q.site, q.page_id, q.ordinal, q.text AS question, n.ordinal - q.ordinal AS ahead, n.type, n.text, {_STOP.replace('type', 'n.type').replace('text', 'n.text')} AS stops, n.type IN ('faq_answer', 'paragraph', 'list_item') AS says
                 FROM q JOIN b n ON n.page_id = q.page_id AND n.ordinal BETWEEN q.ordinal + 1 AND q.ordinal + 4),
           c1 AS (SELECT *, count(*) FILTER (WHERE says AND NOT stops) OVER w AS said, bool_or(stops) OVER w AS stopped FROM a WINDOW w AS (PARTITION BY page_id, ordinal ORDER BY ahead)),
           c2 AS (SELECT *, coalesce(bool_or(stopped OR (type <> 'faq_answer' AND said >= 2)) OVER (PARTITION BY page_id, ordinal ORDER BY ahead ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM c1),
           d AS (SELECT site, page_id, ordinal, question, string_agg(text, ' ' ORDER BY ahead) AS answer, count(*) AS n FROM c2 WHERE says AND NOT stops AND NOT over GROUP BY ALL),
           e AS (SELECT site, {R.stable_id('faq', "lower(question) || chr(0) || lower(answer)")} AS faq_id, page_id, ordinal, question, answer, CASE WHEN n >= 2 THEN 84 ELSE 70 END AS score, CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM d)
           SELECT site, faq_id, question, answer, count(*) AS n FROM e GROUP BY ALL""")
def x11e_made_faqs(t: Tables) -> DataFrame:
    """The FAQs of each site with the number of places where they stand; each site and page being one in the operator."""
    from pyspark.sql.window import Window as W

    k = c("l_partkey") + c("l_suppkey")
    ordinal = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    blocks = t.lineitem.select(
        (c("l_partkey") % 40).alias("site"), c("l_orderkey").alias("page_id"), ordinal.alias("ordinal"), _pick(KINDS, k).alias("type"),
        _pick(TEXTS, k + F.when(c("l_suppkey") % 3 == 0, c("l_partkey") % 4).otherwise(0)).alias("text"), F.when(c("l_orderkey") % 3 == 0, "faq").otherwise("page").alias("page_type"),
    )
    # Each question as a site of its own: the operator then keeps every place.
    apart = blocks.withColumn("site", F.struct("site", "page_id", "ordinal"))
    return O.faqs(apart).groupBy("site.site", "faq_id", "question", "answer").agg(F.count("*").alias("n"))

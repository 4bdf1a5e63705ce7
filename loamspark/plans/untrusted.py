"""Event metadata and sitemaps made of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import untrusted as O
from .registry import Tables, query

c = F.col


@query(r"""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 9 AS k, o_orderpriority AS p FROM orders)
           SELECT id, CASE WHEN k = 0 THEN 'operational_event_metadata_unsafe_key' WHEN k = 1 THEN 'operational_event_metadata_too_deep' WHEN k = 2 THEN 'operational_event_metadata_array_too_large' WHEN k = 3 THEN 'operational_event_metadata_invalid_value'
                              WHEN k = 4 THEN 'operational_event_metadata_too_large' END AS code,
                  CASE WHEN k < 5 THEN NULL WHEN k = 5 THEN '{}' WHEN k = 6 THEN '{"a":"' || repeat('x', 256) || '","b":[1,true,null,"' || p || '"]}' ELSE '{"deep":{"er":{"est":' || id || '}}}' END AS metadata FROM x""")
def k6_safe_metadata(t: Tables) -> DataFrame:
    k, id = c("o_orderkey") % 9, c("o_orderkey").cast("string")
    long = F.concat(F.lit('{"a": "'), F.expr("repeat('x', 300)"), F.lit('", "b": [1, true, null, "'), c("o_orderpriority"), F.lit('"]}'))
    text = F.when(k == 0, '{"fine": {"userPassWord": 1}}').when(k == 1, '{"a": [[[[1]]]]}').when(k == 2, F.concat(F.lit('{"a": [0'), F.expr("repeat(',1', 20)"), F.lit("]}"))).when(k == 3, F.when(c("o_orderkey") % 2 == 0, "{broken").otherwise("[1]"))
    text = text.when(k == 4, F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('": "'), F.expr("repeat('é', 250)"), F.lit('"'))), ","), F.lit("}")))
    text = text.when(k == 6, long).when(k > 6, F.concat(F.lit('{"deep": {"er": {"est": '), id, F.lit("}}}")))
    return t.orders.select(c("o_orderkey").alias("id"), O.safe_metadata(text).alias("m")).select("id", "m.code", "m.metadata")


@query("""WITH s AS (SELECT s_suppkey AS site, 'https://s' || s_suppkey || '.example/' AS root, s_suppkey % 3 AS depth FROM supplier), p AS (SELECT p_partkey AS k FROM part WHERE p_partkey <= 30)
          SELECT site, unnest(list_filter([root || 'a&b', CASE WHEN depth >= 1 THEN root || 'one' END, CASE WHEN depth >= 2 THEN root || 'two' END], lambda x: x IS NOT NULL)) AS url FROM s""")
def s2_sitemap_pages(t: Tables) -> DataFrame:
    """Sites whose indexes nest up to two levels, name themselves, other hosts and what was never fetched."""
    k = c("s_suppkey")
    root = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example/"))
    index = lambda *urls: F.concat(F.lit("<sitemapindex>"), *(F.concat(F.lit("<sitemap><loc> "), u, F.lit("</loc></sitemap>")) for u in urls), F.lit("</sitemapindex>"))
    pages = lambda *urls: F.concat(F.lit("<urlset>"), *(F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>")) for u in urls), F.lit("</urlset>"))
    at = lambda x: F.concat(root, F.lit(x))
    first = F.when(k % 3 == 0, index(at("root.xml"), at("m0.xml"), at("gone.xml"))).when(k % 3 == 1, index(at("m0.xml"), at("m1.xml"), F.lit("https://elsewhere.example/m.xml"))).otherwise(index(at("m0.xml"), at("m1.xml"), at("deep.xml")))
    rows = [("root.xml", first), ("m0.xml", pages(at("a&amp;b"), F.lit("https://elsewhere.example/x"))), ("m1.xml", pages(at("one"))), ("deep.xml", index(at("root.xml"), at("m2.xml"))), ("m2.xml", pages(at("two"), at("two")))]
    documents = None
    for name, body in rows:
        one = t.supplier.select(at(name).alias("url"), body.alias("body"))
        documents = one if documents is None else documents.union(one)
    return O.followed_sitemaps(documents, t.supplier.select(k.alias("site"), at("root.xml").alias("url")))[0]


# --- X16: outputs of a model, one of nine kinds for each order ---------------------------

_FACT = '"category": "{0}", "content": "{1}", "sourceBlockId": "{2}", "source_excerpt": "{3}", "confidenceScore": 0.9'
OUTPUTS = [
    '{"facts": [{' + x + "}]}"
    for x in (
        _FACT.format("service", "Repairs of bikes", "b1", "repairs of all bikes"), _FACT.format("none", "Repairs", "b1", "x"), _FACT.format("policy", "abc", "b1", "x"), _FACT.format("policy", "Long enough", "b7", "x"),
        _FACT.format("policy", "Long enough", "b1", " "), _FACT.format("policy", "Long enough", "b1", "we sell boats and cars"),
    )
]
OUTPUTS += ['{"faq_candidates": [{"question": "Q?", "answer": ""}], "conflicts": [{}]}', "[]", '{"facts": [' + ", ".join(["{" + _FACT.format("service", "Repairs of bikes", "b1", "repairs of all bikes") + "}"] * 2) + '], "missingInformation": [{"topic": "t", "reason": "r", "suggested_question": "q"}]}']
CODES = [[], [("invalid_category", "facts[0].category")], [("invalid_fact", "facts[0].content")], [("missing_source_block", "facts[0].sourceBlockId")], [("missing_source_excerpt", "facts[0].sourceExcerpt")],
         [("source_excerpt_not_found", "facts[0].sourceExcerpt")], [("invalid_faq_candidate", "faqCandidates[0]"), ("invalid_conflict", "conflicts[0]")], [("invalid_root", "$")], [("duplicate_item", "facts")]]
_ROWS = ", ".join(f"({i}, '{code}', '{path}')" for i, own in enumerate(CODES) for code, path in own)


def _extracted(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..operators import extraction as X

    k = c("o_orderkey")
    outputs = t.orders.select(c("o_custkey").alias("project"), k.alias("extraction"), F.element_at(F.array(*map(F.lit, OUTPUTS)), (k % len(OUTPUTS)).cast("int") + 1).alias("output"))
    return X.validate(outputs, t.customer.select(c("c_custkey").alias("project"), F.lit("b1").alias("id"), F.lit("We offer repairs of  all Bikes.").alias("content")))


@query(f"SELECT o_custkey AS project, o_orderkey AS extraction, code, path FROM orders JOIN (VALUES {_ROWS}) v(kind, code, path) ON kind = o_orderkey % {len(OUTPUTS)}")
def x16_extraction_issues(t: Tables) -> DataFrame:
    return _extracted(t)[1]


@query(f"""SELECT o_custkey AS project, o_orderkey AS extraction, kind, 0 AS nth, key FROM orders JOIN (VALUES (0, 'fact', 'service:Repairs of bikes'), (8, 'fact', 'service:Repairs of bikes'), (8, 'missing', 't')) v(n, kind, key) ON n = o_orderkey % {len(OUTPUTS)}""")
def x16_accepted_items(t: Tables) -> DataFrame:
    return _extracted(t)[0].drop("confidence", "id")

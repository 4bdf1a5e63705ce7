"""Crawl post-processing on pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import html as H
from ..operators import pages as O
from . import registry as R
from .facts import SECTIONS, _blocks
from .registry import Tables, lit, query
from .texts import DUCK_URL, N3


@query()
def x1_semantic_blocks(t: Tables) -> DataFrame:
    return H.semantic_blocks(t.pages).groupBy("site", "page_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("type") == "heading").alias("headings"), F.sum(F.length("text")).alias("chars"))


@query(DUCK_URL + r"""
    , l AS (SELECT page_id, origin, unnest(range(len(h))) AS place, unnest(h) AS href FROM (SELECT page_id, origin, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''#]+)', 1) AS h FROM p JOIN pages USING (page_id)))
    SELECT page_id, regexp_extract(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE origin || href END, '^[^?#]*') AS target, min(place)::BIGINT AS place FROM l
    WHERE (regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') AND starts_with(href, origin)) OR starts_with(href, '/') GROUP BY ALL""", name="x3b_internal_links")
def x3b_internal_links(t: Tables) -> DataFrame:
    return H.links(t.pages)


def _title(tag: str) -> str:
    inner = R.clean(f"regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]+>', '', 'g')")
    return f"CASE WHEN NOT regexp_matches(nullif({inner}, ''), '(?i)^(home|homepage|untitled|index|welcome)$') THEN nullif({inner}, '') END"


@query(DUCK_URL + f"""
    SELECT page_id, coalesce({_title('title')}, {_title('h1')}, nullif(string_split(regexp_replace(path, '/+$', ''), '/')[-1], ''), host) AS title
    FROM q JOIN pages USING (page_id)""")
def x3c_page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", H.title(F.col("html"), F.col("url")).alias("title"))


@query(rf"""SELECT site, md5({N3.format(R.clean('text'))}) AS key, count(DISTINCT page_id) AS pages FROM
           (SELECT source AS site, doc_id AS page_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents)
           WHERE {R.clean('text')} <> '' AND NOT {R.is_match('text', O.PROTECTED)} GROUP BY ALL HAVING count(DISTINCT page_id) >= {O.PAGES}""")
def a8_site_boilerplate(t: Tables) -> DataFrame:
    return O.boilerplate(_blocks(t, t.spread("documents").select("doc_id", "source", "text")))


X4_SQL = rf"""
    WITH raw AS (SELECT source AS site, doc_id AS page_id, 'https://' || source || '.example.com/' || {list(SECTIONS)!r}[doc_id % {len(SECTIONS)} + 1] || '/' || doc_id AS url, {N3.format(R.clean('text'))} AS norm FROM documents),
    p AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS path FROM raw),
    q AS (SELECT *, CASE WHEN string_split(path, '/')[2] IN ({', '.join(map(lit, O.CORE))}) THEN 10000 WHEN string_split(path, '/')[2] IN ({', '.join(map(lit, O.SUPPLEMENTARY))}) THEN 300 ELSE 100 END
                 + greatest(0, 200 - length(path)) AS rank, string_split(norm, ' ') AS words FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY rank DESC, url, page_id) AS place,
                 first_value(page_id) OVER (PARTITION BY site, CASE WHEN norm = '' THEN page_id::VARCHAR ELSE norm END ORDER BY rank DESC, url, page_id) AS first_id FROM q),
    s AS (SELECT site, page_id, place, list_distinct(list_transform(range(1, len(words) - {O.SHINGLE - 2}), lambda i: array_to_string(words[i:i + {O.SHINGLE - 1}], ' '))) AS grams
          FROM o WHERE first_id = page_id AND len(words) >= {O.WORDS}),
    near AS (SELECT DISTINCT a.page_id FROM s a JOIN s b ON a.site = b.site AND b.place < a.place
             WHERE len(list_intersect(a.grams, b.grams)) >= {O.OVERLAP} * least(len(a.grams), len(b.grams)))
    SELECT site, o.page_id, CASE WHEN first_id <> o.page_id THEN 'exact' WHEN near.page_id IS NOT NULL THEN 'near' END AS reason FROM o LEFT JOIN near USING (page_id)"""


@query(X4_SQL)
def x4_page_dedup(t: Tables) -> DataFrame:
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("doc_id") % len(SECTIONS) + 1).cast("int"))
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), section, F.lit("/"), F.col("doc_id").cast("string"))
    return O.deduplicate(t.spread("documents").select(F.col("source").alias("site"), F.col("doc_id").alias("page_id"), url.alias("url"), "text"))


@query(DUCK_URL + """, r AS (SELECT page_id, origin || short AS key, length(url) AS n FROM q)
    SELECT page_id, row_number() OVER (PARTITION BY key ORDER BY n, page_id) = 1 AS kept FROM r""")
def x4_canonical_urls(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window as W

    u = F.col("url")
    key = F.concat(U.origin(u), F.when(U.path(u) == "/", "/").otherwise(F.regexp_replace(U.path(u), "/+$", "")))
    n = F.row_number().over(W.partitionBy(key).orderBy(F.length(u), "page_id"))
    return t.pages.select("page_id", (n == 1).alias("kept"))


@query(rf"""SELECT doc_id, length(text) < 80 AS too_short, {R.is_match('text', O.PROTECTED)} AS protected,
           len(regexp_extract_all(lower(text), '\b(?:home|about|services|products|contact|blog|pricing|login|menu)\b')) >= 6 AND {R.is_match('text', r'\b(?:privacy|terms|rights reserved)\b')} AS chrome FROM documents""")
def p13_text_gates(t: Tables) -> DataFrame:
    c = F.col("text")
    nav = F.size(F.regexp_extract_all(F.lower(c), F.lit(T.ascii_words(r"\b(?:home|about|services|products|contact|blog|pricing|login|menu)\b")), F.lit(0))) >= 6
    return t.documents.select("doc_id", (F.length(c) < 80).alias("too_short"), O.protected(c).alias("protected"), (nav & T.matches(c, r"\b(?:privacy|terms|rights reserved)\b")).alias("chrome"))

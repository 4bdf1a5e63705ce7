"""Extraction batches of the given pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batching as O
from .registry import Tables, query

c = F.col
MOST = 6000


def _pages(t: Tables) -> DataFrame:
    """Hosts as projects, the whole html as the text to send."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return t.pages.select(host.alias("project"), c("page_id").alias("page"), F.concat(F.lit("p"), c("page_id").cast("string")).alias("source"), "url", F.lit("page").alias("type"), F.when(c("page_id") % 3 == 0, "A title").otherwise("").alias("title"), c("html").alias("text"))


UNITS = f"""p AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS project, page_id AS page, coalesce(html, '') AS text, length(coalesce(html, '')) AS n,
              length('PAGE ' || page_id || 'SOURCE ID: p' || page_id || 'URL: ' || coalesce(url, '') || 'TYPE: page' || 'CHUNK:  OF CONTENT:') + 5 + CASE WHEN page_id % 3 = 0 THEN 15 ELSE 0 END AS head FROM pages),
    cut(project, page, chunk, pos, len) AS (SELECT project, page, 1, 0, {MOST} - head - length(n::VARCHAR) - 2 FROM p WHERE head + 2 + n + (n > 0)::INT > {MOST}
        UNION ALL SELECT cut.project, cut.page, chunk + 1, pos + len, {MOST} - head - length(n::VARCHAR) - length((chunk + 1)::VARCHAR) - 1 FROM cut JOIN p ON p.page = cut.page WHERE pos + len < n),
    u0 AS MATERIALIZED (SELECT project, page, 1 AS chunk, 1 AS chunks, 0 AS pos, n AS len FROM p WHERE page NOT IN (SELECT page FROM cut)
        UNION ALL SELECT project, page, chunk, count(*) OVER (PARTITION BY page), pos, len FROM cut),
    u AS MATERIALIZED (SELECT u0.project, u0.page, chunk, chunks, substr(text, pos + 1, len) AS text, head + length(chunk::VARCHAR) + length(chunks::VARCHAR) + least(len, n - pos) + (n > 0)::INT AS size, row_number() OVER (PARTITION BY u0.project ORDER BY u0.page, chunk) - 1 AS place FROM u0 JOIN p ON p.page = u0.page),
    g(project, place, batch, used) AS (SELECT project, place, 1, size FROM u WHERE place = 0
        UNION ALL SELECT g.project, u.place, CASE WHEN used + {len(O.BETWEEN)} + size > {MOST} THEN batch + 1 ELSE batch END, CASE WHEN used + {len(O.BETWEEN)} + size > {MOST} THEN size ELSE used + {len(O.BETWEEN)} + size END FROM g JOIN u ON u.project = g.project AND u.place = g.place + 1)"""


@query(f"WITH RECURSIVE {UNITS} SELECT u.project, page, chunk, chunks, size, u.place, batch, md5(text) AS text FROM u JOIN g ON g.project = u.project AND g.place = u.place")
def x12_extraction_batches(t: Tables) -> DataFrame:
    found = O.batches(_pages(t), MOST)
    return found.select("project", "page", "chunk", "chunks", "size", "place", "batch", F.md5(c("text").cast("binary")).alias("text"))


@query()
def x12b_halved_batches(t: Tables) -> DataFrame:
    """Batches above half the size fail and are halved until none does."""
    sent = O.batches(_pages(t), MOST).select("project", "page", "batch", "place", "chunk", "chunks", "text", "size")
    found = O.halved(sent, lambda b: b.where(c("size") > MOST // 2))
    return found.groupBy("project", "batch").agg(F.count("*").alias("units"), F.sum("size").alias("size"), F.bool_or("refused").alias("refused"))

"""Normalisers, urls, ids, sentences and similarity on documents and pages (N1-N9 and the functions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import registry as R
from .registry import Tables, query


@query(f"SELECT doc_id, md5({R.clean('text')}) AS digest, length({R.clean('text')})::BIGINT AS n FROM documents")
def n1_clean_text(t: Tables) -> DataFrame:
    c = T.clean(F.col("text"))
    return t.documents.select("doc_id", F.md5(c.cast("binary")).alias("digest"), F.length(c).cast("long").alias("n"))


@query(f"SELECT doc_id, md5({R.key('text')}) AS digest FROM documents")
def n2_key_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.key_text(F.col("text")).cast("binary")).alias("digest"))


N3 = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '(https?://[^ ?#]+)[?#][^ ]*', '\\1', 'g'), '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, md5({N3.format(R.clean('text'))}) AS digest FROM documents")
def n3_page_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.page_text(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(lower({R.clean('text')}), '[^a-z0-9$%./:-]+', ' ', 'g'))) AS digest FROM documents")
def n4_comparable_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.comparable_text(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({R.merge_value('text')}) AS digest FROM documents")
def n5_merge_value(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.merge_value(F.col("text")).cast("binary")).alias("digest"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'),
          '\\b(the|a|an|policy|policies|faq|faqs)\\b', ' ', 'g'), ' +', ' ', 'g'))) AS digest FROM documents""")
def n7_conflict_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.conflict_key(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT item_id, {R.slug('text')} AS slug FROM benchmark")
def n9_slug(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", T.slug(F.col("text")).alias("slug"))


@query(f"SELECT item_id, {R.stable_id('item', 'text')} AS id, 'item_' || lower(to_hex({R.fnv('text')})) AS plain_id, sha256(text) AS digest FROM benchmark")
def id_stable_hashes(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.benchmark.select("item_id", T.stable_id("item", c).alias("id"), T.stable_id("item", c, padded=False).alias("plain_id"), F.sha2(c, 256).alias("digest"))


SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?]){T.SPACE}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)),
             lambda s: {R.clean('s')}), lambda s: length(s) BETWEEN 12 AND 1200)"""


@query(f"SELECT doc_id, len({SENTENCES})::BIGINT AS n, md5(array_to_string({SENTENCES}, '|')) AS digest FROM documents")
def p5_sentences(t: Tables) -> DataFrame:
    s = T.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("digest"))


DUCK_URL = r"""
    WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS origin,
                      lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
                      CASE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path,
                      regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
         q AS (SELECT *, CASE path WHEN '/' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS short FROM p)"""


@query(DUCK_URL + r"""
    SELECT page_id, host, path, regexp_replace(host, '^www\.', '') AS bare,
           origin || short || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid)(=|$)'))), '&'), ''), '') AS canonical,
           origin || short || coalesce('?' || nullif(query, ''), '') AS comparable, origin || path AS dedupe FROM q""")
def url_forms(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", U.host(u).alias("host"), U.path(u).alias("path"), U.bare_host(u).alias("bare"), U.canonical(u).alias("canonical"), U.comparable(u).alias("comparable"), U.dedupe(u).alias("dedupe"))


@query(DUCK_URL + f"""
    SELECT page_id, NOT list_has_any(string_split(lower(path), '/'), {list(U.EDITORIAL)!r})
           AND NOT coalesce(regexp_matches(list_filter(string_split(path, '/'), lambda s: s <> '')[1], '^(19|20)[0-9]{{2}}$'), false)
           AND NOT (contains(path, '.') AND list_contains({list(U.ASSETS)!r}, string_split(lower(path), '.')[-1])) AS discoverable,
           regexp_matches(path, '^/(de|fr|es|it|pt|nl|ja|zh)(/|$)') AS localized FROM q""")
def p9_discoverable(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.discoverable(F.col("url")).alias("discoverable"), U.localized(F.col("url")).alias("localized"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)bearer\s+[A-Za-z0-9._~+/-]+=*', '[redacted]', 'g'),
          '(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)[^\s,;]+', '\1\2[redacted]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted]', 'g')) AS digest FROM documents""")
def fn_secret_redaction(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.redact(F.col("text")).cast("binary")).alias("digest"))


A, B = R.tokens("a.text", 3), R.tokens("b.text", 3)


@query(f"""SELECT a.item_id, b.item_id AS other_id, round(CASE WHEN least(len({A}), len({B})) > 0 THEN len(list_intersect({A}, {B})) / least(len({A}), len({B})) ELSE 0 END, 6) AS overlap
           FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def fn_overlap_coefficient(t: Tables) -> DataFrame:
    a = t.benchmark.select("item_id", T.tokens(F.col("text"), 3).alias("a"))
    b = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other_id"), T.tokens(F.col("text"), 3).alias("b"))
    return a.join(b, "item_id").select("item_id", "other_id", F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?')))::BIGINT AS n_numbers,
           regexp_matches(text, '(?i)\b(?:no|not|never|without|cannot|can''t|don''t|doesn''t|won''t|isn''t|aren''t)\b') AS negated FROM documents""")
def fn_numbers_and_negation(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.numbers(F.col("text"))).cast("long").alias("n_numbers"), T.negated(F.col("text")).alias("negated"))

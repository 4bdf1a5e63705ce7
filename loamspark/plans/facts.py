"""The fact engine on the driver's tables.

Documents stand for pages: their lines are blocks, their source is the site, and their urls take
a section from a fixed list so that page-bound rules are exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as K
from ..functions import text as T
from ..operators import facts as O
from ..operators import html as H
from . import registry as R
from .registry import Tables, lit, query

SECTIONS = ("about", "services", "products", "pricing", "contact", "x", "policies", "technical", "case-studies", "blog")


def _blocks(t: Tables, docs: DataFrame | None = None) -> DataFrame:
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("doc_id") % len(SECTIONS) + 1).cast("int"))
    url = F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example.com/"), section, F.lit("/"), F.col("doc_id").cast("string"))
    return O.text_blocks(t.documents if docs is None else docs, url, F.lit(None).cast("string"))


def _normalised(t: Tables) -> DataFrame:
    return O.normalise(_blocks(t))


def _facts(t: Tables) -> DataFrame:
    return O.extract(_normalised(t))


def _scored(t: Tables) -> DataFrame:
    return O.assessed(_facts(t))


def _is(x: str, pattern: str) -> str:
    return R.is_match(x, pattern)


def _type_sql() -> str:
    cases = " ".join(f"WHEN {_is('signals', p)} THEN {lit(name)}" for name, p in K.PAGE_TYPES)
    return f"CASE {cases} WHEN path = '/' THEN 'home' ELSE 'other' END"


def _lane_sql() -> str:
    cases = " ".join(f"WHEN {_is('lane_signal', p)} THEN {lit(name)}" for name, p in K.LANES)
    pages = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in K.PAGE_LANES.items())
    return f"CASE {cases} ELSE CASE page_type {pages} ELSE 'unknown' END END"


BLOCKS_SQL = f"""
    lines AS (SELECT source AS site, doc_id AS page_id, 'https://' || coalesce(source, 'none') || '.example.com/' || {list(SECTIONS)!r}[doc_id % {len(SECTIONS)} + 1] || '/' || doc_id AS url,
                     unnest(range(len(parts))) AS ordinal, unnest(list_transform(parts, lambda s: {R.clean('s')})) AS text
              FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
    blocks AS (SELECT *, CASE WHEN ordinal = 0 AND length(text) <= 80 THEN 'heading' ELSE 'paragraph' END AS type FROM lines WHERE text <> ''),
    headed AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS heading,
                      regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, {R.key('text')} AS key FROM blocks),
    typed AS (SELECT *, {_type_sql()} AS page_type FROM (SELECT *, {R.key("path || ' ' || coalesce(heading, '')")} AS signals FROM headed)),
    often AS (SELECT site, key FROM typed GROUP BY ALL HAVING count(DISTINCT url) > 1),
    kept AS (SELECT t.* FROM typed t LEFT JOIN often o ON o.site = t.site AND o.key = t.key
             WHERE NOT {_is('t.text', K.CHROME)} AND NOT (o.key IS NOT NULL AND {_is('t.text', K.REPEATED_DROPPED)} AND NOT {_is('t.text', K.REPEATED_KEPT)})),
    norm AS (SELECT *, lag(type) OVER w AS previous_type, lag(text) OVER w AS previous_text, lead(ordinal) OVER w AS next_ordinal
             FROM kept WINDOW w AS (PARTITION BY page_id ORDER BY ordinal))"""


@query(f"WITH {BLOCKS_SQL} SELECT page_id, ordinal::BIGINT AS ordinal, type, page_type, md5(coalesce(heading, '')) AS heading, previous_type, next_ordinal::BIGINT AS next_ordinal FROM norm")
def r1_normalised_blocks(t: Tables) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return _normalised(t).select("page_id", long("ordinal"), "type", "page_type", F.md5(F.coalesce("heading", F.lit("")).cast("binary")).alias("heading"), "previous_type", long("next_ordinal"))


LANES_SQL = f"""
    pages_seen AS (SELECT url, arg_min(page_type, ordinal) AS first_type,
                   count(*) FILTER (WHERE type NOT IN ('heading', 'faq_question') AND {_is('text', K.PRICE)}) > 0 AS priced FROM norm GROUP BY url),
    lanes AS (SELECT n.*, {_lane_sql()} AS own_lane FROM (SELECT *, {R.clean("coalesce(heading, '') || ' ' || url")} AS lane_signal FROM norm) n),
    routed AS (SELECT l.*, CASE WHEN own_lane = 'unknown' AND first_type = 'other' AND priced
               AND NOT ({' OR '.join(_is('l.url', dict(K.LANES)[x]) for x in ('legal', 'editorial', 'proof'))}) THEN 'commercial' ELSE own_lane END AS lane
               FROM lanes l JOIN pages_seen p ON p.url = l.url)"""


@query(f"WITH {BLOCKS_SQL}, {LANES_SQL} SELECT page_id, ordinal::BIGINT AS ordinal, lane FROM routed")
def x9b_lane_routing(t: Tables) -> DataFrame:
    return O.routed(_normalised(t)).select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "lane")


def _hits_sql() -> str:
    out, seen = [], {}
    for r in K.ORDERED:
        test = f"regexp_matches(s, {lit(('(?i)' if r.ignore_case else '') + r.evidence)})"
        if r.pages:
            test += f" AND page_type IN ({', '.join(map(lit, r.pages))})"
        if r.heading:
            test += f" AND {_is('context', r.heading)}"
        if r.category == "certification":
            test += f" AND NOT {_is('s', K.STANDARD)}"
        if r.category in K.COMMERCIAL:
            test += f" AND NOT {_is('s', K.TRACKING)}"
        if r.category in seen:
            test += f" AND NOT ({seen[r.category]})"
        seen[r.category] = test
        out.append(f"CASE WHEN {test} THEN {{'category': {lit(r.category)}, 'rule_title': {lit(r.title)}}} END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


S = f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?]){T.SPACE}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: {R.clean('s')}), lambda s: length(s) BETWEEN 12 AND 1200)"""
HITS_SQL = f"""
    said AS (SELECT *, coalesce(heading, '') || ' ' || CASE WHEN previous_type = 'heading' THEN previous_text ELSE '' END AS context, unnest({S}) AS s
             FROM norm WHERE type NOT IN ('heading', 'faq_question')),
    hit AS (SELECT *, h.category AS category, h.rule_title AS rule_title FROM (SELECT *, unnest({_hits_sql()}) AS h FROM said WHERE NOT {_is('s', K.CONTRACT)}))"""


@query(f"WITH {BLOCKS_SQL}, {HITS_SQL} SELECT site, category, rule_title, count(*) AS n, count(DISTINCT page_id) AS pages FROM hit GROUP BY ALL")
def x5_rule_hits(t: Tables) -> DataFrame:
    hits = O.said(_normalised(t)).select("site", "page_id", F.explode(O.rule_hits(F.col("sentence"), F.col("page_type"), F.col("context"))).alias("hit")).select("site", "page_id", "hit.*")
    return hits.groupBy("site", "category", "rule_title").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def _name(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({R.clean(x)}, {lit('(?i)' + K.NAME_NOISE)}, ''), '^[\\s:–—-]+|[\\s:–—-]+$', '', 'g'), '')"


def _part(x: str, pattern: str) -> str:
    return _name(f"regexp_extract({x}, {lit('(?i)' + pattern)}, 1)")


def _item_sql() -> str:
    cases = []
    for category, patterns in K.NAMED.items():
        found = [_part("v", p) for p in patterns]
        if category == "location_service_area":
            found.append(f"CASE WHEN regexp_matches({R.clean('v')}, {lit(K.BARE_PLACE)}) THEN {_name('v')} END")
        cases.append(f"WHEN {lit(category)} THEN coalesce({', '.join(found)})")
    return f"CASE category {' '.join(cases)} END"


def _expand_sql() -> str:
    entity = lambda x: f"regexp_replace(regexp_replace({R.clean(x)}, '(?i)^(?:and|or)\\s+', ''), '[.,:;]+$', '')"

    def listed(lead: str) -> str:
        found = f"regexp_extract(s, {lit(f'(?i)\\b(?:{lead})\\s+(.+?)(?:[.!]|$)')}, 1)"
        return f"list_filter(list_transform(string_split_regex({found}, '(?i)\\s*(?:,|\\band\\b|\\bor\\b)\\s*'), lambda x: {entity('x')}), lambda x: x <> '')"

    every = lambda p, flag="(?i)": f"regexp_extract_all(s, {lit(flag + p)}, 1)"
    work, tool = lit(rf"(?i)\b(?:{K.WORK_WORDS})\b"), lit(rf"(?i)\b(?:{K.TOOL_WORDS})\b")
    plans = every(r"\b([A-Z][A-Za-z0-9 '&-]*?)\s+(?:plan|package|tier|subscription)\b", "")
    return f"""CASE category
        WHEN 'security_compliance' THEN {every(r"\b(SOC\s*(?:II|2)|HIPAA|ISO\s*27001|GDPR|encryption|encrypted|SSO|MFA)\b")}
        WHEN 'integration' THEN list_filter({listed("integrates? with|connects? (?:to|with)|compatible with|plugins? for")}, lambda x: regexp_matches(x, '^[A-Z][A-Za-z0-9 .+&-]+$'))
        WHEN 'pricing_plan' THEN list_transform({plans}, lambda x: x || ' plan')
        WHEN 'service' THEN list_filter(list_transform({listed("we (?:offer|provide|deliver)|our services? include")}, lambda x: regexp_replace(x, '(?i)\\s+services?$', '')), lambda x: regexp_matches(x, {work}))
        WHEN 'product' THEN list_filter({listed("our products? include|we (?:offer|sell)|products?:")}, lambda x: regexp_matches(x, {tool}))
        WHEN 'location_service_area' THEN list_filter({listed("(?:offices? (?:are )?(?:located )?in)|(?:we )?serve|available (?:in|throughout)|serving")}, lambda x: regexp_matches(x, {lit(K.BARE_PLACE)}))
        ELSE [] END"""


def _topic_sql() -> str:
    spaces = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in K.TOPIC_SPACES.items())
    alias = " ".join(f"WHEN category = {lit(c)} AND {_is('ev', p)} THEN {lit(f'{c}:{a}')}" for c, a, p in K.TOPIC_ALIASES)
    title = f"CASE WHEN NOT {_is(R.clean('heading'), K.GENERIC_HEADINGS)} THEN nullif({R.clean('heading')}, '') END"
    named = f"""CASE category WHEN 'policy' THEN {_part('ev', K.POLICY_NAME)}
        WHEN 'contact_information' THEN CASE WHEN {_is('ev', r'\bsupport\b')} THEN 'support' WHEN {_is('ev', r'\bsales\b')} THEN 'sales'
             ELSE coalesce(nullif(regexp_extract(ev, {lit('(?i)' + K.EMAIL)}), ''), nullif(regexp_extract(ev, {lit(K.PHONE)}), '')) END
        WHEN 'integration' THEN {_part('v', r'\b(?:with|to|for)\s+(.+?)(?:[.!]|$)')}
        WHEN 'product' THEN special WHEN 'service' THEN special WHEN 'industry_served' THEN special WHEN 'location_service_area' THEN special WHEN 'primary_use_case' THEN special END"""
    inner = f"SELECT *, CASE WHEN item IS NOT NULL AND NOT {_is('item', K.BARE_ITEM)} THEN item ELSE {title} END AS special FROM (SELECT *, {_item_sql()} AS item, {_name('v')} AS offered, coalesce(heading, '') || ' ' || v AS ev FROM valued)"
    name = f"CASE WHEN category = 'pricing_plan' THEN coalesce(item, offered) ELSE coalesce({named}, item, offered) END"
    final = f"""CASE WHEN category = 'faq' THEN 'faq:' || {R.slug('v')} {alias}
        ELSE coalesce(CASE category {spaces} END, category) || ':' || coalesce(nullif({R.slug('coalesce(nm, v)')}, ''), 'unknown') END"""
    return f"""
    listed AS (SELECT *, list_filter(list_transform({_expand_sql()}, lambda x: regexp_replace(regexp_replace({R.clean('x')}, '(?i)^(?:and|or)\\s+', ''), '[.,:;]+$', '')), lambda x: {R.key('x')} <> '') AS found FROM hit),
    valued AS (SELECT *, unnest(CASE WHEN len(found) > 1 THEN list_filter(found, lambda x, i: list_position(list_transform(found, lambda y: {R.key('y')}), {R.key('x')}) = i) ELSE [s] END) AS v FROM listed),
    topical AS (SELECT *, {final} AS topic_key FROM (SELECT *, {name} AS nm FROM ({inner}))),
    facts AS (SELECT *, {R.stable_id('det_fact', f"topic_key || chr(0) || {R.key('v')} || chr(0) || 'website'")} AS fact_id,
              CASE WHEN length(heading) >= 3 AND NOT {_is('heading', K.GENERIC_TITLE)} THEN heading ELSE rule_title END AS title FROM topical)"""


FACTS_SQL = f"{BLOCKS_SQL}, {HITS_SQL}, {_topic_sql()}"


@query(f"WITH {FACTS_SQL} SELECT site, fact_id, category, title, topic_key, page_id, ordinal::BIGINT AS ordinal FROM facts")
def x8_facts_with_topics(t: Tables) -> DataFrame:
    return _facts(t).select("site", "fact_id", "category", "title", "topic_key", "evidence.page_id", F.col("evidence.ordinal").cast("long").alias("ordinal"))


def _relevant_sql() -> str:
    return "CASE category " + " ".join(f"WHEN {lit(c)} THEN page_type IN ({', '.join(map(lit, p))})" for c, p in K.RELEVANT_PAGES.items()) + " ELSE false END"


PROOF_SQL = f"(category = 'additional_business_knowledge' AND {_is('''title || ' ' || v''', K.PROOF)})"
GROUPS_SQL = f"""
    keyed AS (SELECT *, CASE WHEN {PROOF_SQL} THEN 'additional_business_knowledge:customer_proof' WHEN category IN ({', '.join(map(lit, K.AGGREGATED))}) THEN topic_key
              ELSE topic_key || chr(0) || regexp_replace(regexp_replace({R.key('v')}, '\\b(the|a|an)\\b', '', 'g'), ' +', ' ', 'g') END AS grp,
              CASE WHEN {_is('v', K.GOOD_EVIDENCE)} THEN 6 ELSE 0 END - CASE WHEN {_is('v', K.BAD_EVIDENCE)} THEN 25 ELSE 0 END AS quality, {_relevant_sql()} AS on_topic FROM facts),
    merged AS (SELECT site, grp, arg_min({{'fact_id': fact_id, 'category': category, 'value': v, 'topic_key': topic_key}}, (-quality, fact_id, v)) AS b, count(*) AS n_facts,
               count(DISTINCT (page_id, ordinal, {R.key('s')})) AS n_evidence, count(DISTINCT url) AS n_urls, bool_or(coalesce(heading <> '', false)) AS headed, bool_or(on_topic) AS on_topic
               FROM keyed GROUP BY site, grp),
    best AS (SELECT site, grp, b.fact_id AS fact_id, b.category AS category, b.value AS v, CASE WHEN grp = 'additional_business_knowledge:customer_proof' THEN grp ELSE b.topic_key END AS topic_key,
             n_facts, n_evidence, n_urls, headed, on_topic FROM merged),
    material AS (SELECT *, coalesce(nullif(array_to_string(list_sort(regexp_extract_all({R.key('v')}, {lit(K.MATERIAL)})), '|'), ''), {R.key('v')}) AS m FROM best),
    conflict AS (SELECT site, topic_key, count(*) AS n, count(DISTINCT m) AS n_values, min(fact_id) AS preferred FROM material GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT m) >= 2),
    scored AS (SELECT b.*, c.topic_key IS NOT NULL AS conflict, greatest(5, least(99, 46 + 10 + CASE WHEN headed THEN 5 ELSE 0 END + CASE WHEN on_topic THEN 8 ELSE 0 END
               + least(12, (n_evidence - 1) * 4) + least(8, (n_urls - 1) * 4) - CASE WHEN length(v) < 20 THEN 8 ELSE 0 END - CASE WHEN {_is('v', K.HEDGE)} THEN 8 ELSE 0 END
               - CASE WHEN c.topic_key IS NOT NULL THEN 18 ELSE 0 END)) AS score FROM best b LEFT JOIN conflict c ON c.site = b.site AND c.topic_key = b.topic_key)"""


@query(f"WITH {FACTS_SQL}, {GROUPS_SQL} SELECT site, fact_id, category, topic_key, n_facts, n_evidence, n_urls, headed, on_topic FROM best")
def x10_merged_facts(t: Tables) -> DataFrame:
    return O.deduplicate(_facts(t)).select("site", "fact_id", "category", "topic_key", "n_facts", "n_evidence", "n_urls", "headed", "on_topic")


@query(f"WITH {FACTS_SQL}, {GROUPS_SQL} SELECT * FROM conflict")
def x11_conflicts(t: Tables) -> DataFrame:
    return O.conflicts(O.deduplicate(_facts(t))).select("site", "topic_key", "n", "n_values", "preferred")


@query(f"WITH {FACTS_SQL}, {GROUPS_SQL} SELECT site, fact_id, category, score, CASE WHEN score >= 78 THEN 'high' WHEN score >= 52 THEN 'medium' ELSE 'low' END AS confidence, conflict FROM scored")
def x11b_confidence(t: Tables) -> DataFrame:
    return _scored(t).select("site", "fact_id", "category", "score", "confidence", "conflict")


COVERAGE_SQL = f"""
    fields(field, category) AS (VALUES {', '.join(f'({lit(f)}, {lit(c)})' for f, cs in K.COVERAGE.items() for c in cs)}),
    covered AS (SELECT site, field, CAST(round(greatest(0.0, least(100.0, avg(score) * 0.72 + least(18, sum(n_urls) * 6) + least(10, count(*) * 2) - CASE WHEN bool_or(conflict) THEN 18 ELSE 0 END))) AS BIGINT) AS coverage
                FROM scored JOIN fields USING (category) GROUP BY ALL)"""


@query(f"WITH {FACTS_SQL}, {GROUPS_SQL}, {COVERAGE_SQL} SELECT * FROM covered")
def x11c_coverage(t: Tables) -> DataFrame:
    return O.coverage(_scored(t))


CORE = [f"coalesce(max(coverage) FILTER (WHERE field = {lit(f)}), 0)" for f in K.CORE_FIELDS]


@query(f"""WITH {FACTS_SQL}, {GROUPS_SQL}, {COVERAGE_SQL} SELECT site, CAST(round(({' + '.join(CORE)}) / 4 * 0.55 + sum(coverage) / {len(K.COVERAGE)} * 0.45) AS BIGINT) AS overall,
           array_to_string(list_filter([{', '.join(f'CASE WHEN {c} < 45 THEN {lit(f)} END' for c, f in zip(CORE, K.CORE_FIELDS, strict=True))}], lambda x: x IS NOT NULL), ',') AS missing FROM covered GROUP BY site""")
def x11d_missing_information(t: Tables) -> DataFrame:
    return O.overall(O.coverage(_scored(t)))


@query()
def x11e_faqs(t: Tables) -> DataFrame:
    return O.faqs(_normalised(t))


@query()
def top_facts_per_category(t: Tables) -> DataFrame:
    """Web pages to blocks, facts, confidence: for each host and category the numbers behind the flagship."""
    blocks = H.semantic_blocks(t.pages)
    norm = O.normalise(blocks)
    facts = O.assessed(O.extract(norm))
    by_lane = O.routed(norm).groupBy("site").agg(F.count("*").alias("blocks"), F.countDistinct("page_id").alias("pages"), F.countDistinct("lane").alias("lanes"))
    top = facts.groupBy("site", "category").agg(F.count("*").alias("facts"), F.max("score").alias("best_score"), F.max_by("value", F.struct("score", "fact_id")).alias("best_value"))
    return by_lane.join(top, "site", "left")

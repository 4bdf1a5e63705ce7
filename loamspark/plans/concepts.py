"""Concepts, relationships and owners on facts made of parts (X11f-X11i, X9d, A5, A6, J4, J8, P7, P8, R14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import concept_rules as K
from ..operators import concepts as O
from . import registry as R
from .registry import Tables, lit, query

CATEGORIES = [*K.BASELINES, "company_overview", "customer_segment", "primary_use_case", "competitive_differentiator", "additional_business_knowledge", "faq"]
STATEMENTS = [
    "A includes B for $20 per month.",
    "A integrates with B and is the flagship choice.",
    "Our company serves B as a team; A serves B nationwide.",
    "A applies to B; refunds will be made within 30 days if required.",
    "Contact A support for B by email: help@example.com.",
    "A is available in B and is certified with years of experience.",
    "A belongs to B as a secondary, minor item.",
    "You should consider A; learn more about tips.",
    "Short.",
    "A is essential, included and official; ISO 27001 compliant security.",
    "Learn more about A at $5 and $9, setup fee per month, cost per year.",
    "We offer A and help teams; located in Oslo.",
    "Available only to members of A.",
]
LANES = ["core_business", "commercial", "market_customer", "operations", "technical", "proof", "legal", "editorial", "unknown"]


def _pick(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))


def _facts(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    line, other = F.floor(k / 15) % 12, (size + F.floor(k / 7)) % 12
    name, target = F.concat(F.lit("Line "), line.cast("string")), F.concat(F.lit("Line "), other.cast("string"))
    value = F.regexp_replace(F.regexp_replace(_pick(STATEMENTS, F.floor(k / 5)), F.lit(r"\bA\b"), name), F.lit(r"\bB\b"), target)
    facts = t.part.select(
        k.alias("fact_id"), _pick(CATEGORIES, k).alias("category"), name.alias("title"), value.alias("value"), (size + 40).alias("score"),
        F.concat(_pick(CATEGORIES, k), F.lit(":line_"), line.cast("string")).alias("topic_key"), F.when(k % 6 == 0, "owner").otherwise("website").alias("provenance"),
        F.concat(F.lit("doc"), (size % 3).cast("string")).alias("source"), (k % 10 != 0).alias("explicit"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(_pick(LANES, size), _pick(LANES, k))).alias("lanes"),
    )
    return facts


def _conflicts(facts: DataFrame) -> DataFrame:
    """Topics with statements of the least and the greatest score."""
    return facts.groupBy("topic_key").agg(F.count_if(F.col("score") > 88).alias("n")).where("n > 0")


FACTS = f"""
    facts AS (SELECT p_partkey AS fact_id, {CATEGORIES!r}[p_partkey % {len(CATEGORIES)} + 1] AS category, 'Line ' || (p_partkey // 15) % 12 AS title,
                     regexp_replace(regexp_replace({STATEMENTS!r}[(p_partkey // 5) % {len(STATEMENTS)} + 1], '\\bA\\b', 'Line ' || (p_partkey // 15) % 12, 'g'), '\\bB\\b', 'Line ' || (p_size + p_partkey // 7) % 12, 'g') AS value,
                     p_size + 40 AS score, {CATEGORIES!r}[p_partkey % {len(CATEGORIES)} + 1] || ':line_' || (p_partkey // 15) % 12 AS topic_key, CASE WHEN p_partkey % 6 = 0 THEN 'owner' ELSE 'website' END AS provenance,
                     'doc' || p_size % 3 AS source, p_partkey % 10 <> 0 AS explicit,
                     CASE WHEN p_partkey % 5 = 0 THEN []::VARCHAR[] ELSE [{LANES!r}[p_size % {len(LANES)} + 1], {LANES!r}[p_partkey % {len(LANES)} + 1]] END AS lanes FROM part),
    conflicts AS (SELECT topic_key, count(*) AS n FROM facts WHERE score > 88 GROUP BY 1)"""


def _case(pairs: list[tuple[str, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {rest} END"


def _in(x: str, names: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(map(lit, names))})" if names else "true"


def _score_sql(i: int) -> str:
    out = _case([(f"category = {lit(c)}", str(b[i])) for c, b in K.BASELINES.items()], "20")
    for name, own, kind, amounts in K.ADJUSTMENTS:
        out = _case([(f"is_{name} AND {_in('category', own)}", f"{out} + {amounts[i]}" if kind == "add" else f"greatest({out}, {amounts[i]})")], out)
    return f"greatest(0, least(100, {out}))"


def _fold(x: str, p: str, fold: bool) -> str:
    return R.is_match(x, p) if fold else f"regexp_matches({x}, {lit(p)})"


WORDS = "regexp_replace(topic_key, '[_:]', ' ', 'g') || ' ' || title || ' ' || value"
NAME = "'Line ' || replace(regexp_replace(topic_key, '^[^:]*:', ''), 'line_', '') || " + _case([(f"starts_with(topic_key, '{s}:')", f"' {x}'") for s, x in K.SUFFIXES.items()], "''")
CONCEPTS = f"""{FACTS},
    grouped AS (SELECT topic_key, min(category) AS category, round(avg(score))::INT AS confidence, count(*) AS n_facts, count(DISTINCT CASE WHEN provenance = 'owner' THEN 'owner' ELSE source END) AS n_sources,
                       bool_or(provenance = 'owner') AS owner, bool_or(provenance = 'website') AS website, min(source) AS first_source, max(source) AS last_source,
                       {', '.join(f"bool_or({R.is_match(WORDS, p)}) AS is_{name}" for name, p in K.WORDING.items())},
                       list_filter([{', '.join(f"CASE WHEN min(category) = {lit(c)} AND NOT bool_or({_fold('value', p, fold)}) THEN {lit(name)} END" for c, name, p, fold in K.SIGNALS)}], lambda x: x IS NOT NULL) AS missing
                FROM facts WHERE {_in('category', tuple(K.BASELINES))} GROUP BY 1),
    valued AS (SELECT g.*, coalesce(n, 0) AS n_conflicts, coalesce(n, 0) > 0 AS conflicted, {NAME} AS name, {', '.join(f'{_score_sql(i)} AS {side}' for i, side in enumerate(('business', 'assistant', 'customer')))},
                      greatest(0, least(100, confidence + CASE WHEN n_sources >= 2 THEN 8 WHEN n_sources = 1 THEN -10 ELSE -20 END + CASE WHEN n_facts >= 2 THEN 4 ELSE 0 END + CASE WHEN owner AND website AND coalesce(n, 0) = 0 THEN 6 ELSE 0 END
                               - least(45, coalesce(n, 0) * 30) - least(12, len(missing) * 4)))::INT AS health FROM grouped g LEFT JOIN conflicts USING (topic_key)),
    ranked AS (SELECT *, CASE WHEN conflicted OR confidence < 52 OR health < 50 THEN 'needs_attention' WHEN health >= 75 AND n_sources >= 2 AND len(missing) = 0 THEN 'strong' ELSE 'review_recommended' END AS status,
                      round(business * 0.4 + assistant * 0.35 + customer * 0.25)::INT AS importance FROM valued),
    concepts AS (SELECT *, CASE WHEN importance >= 85 THEN 'critical' WHEN importance >= 70 THEN 'high' WHEN importance >= 45 THEN 'medium' ELSE 'low' END AS level FROM ranked)"""


@query(f"WITH {CONCEPTS} SELECT topic_key, category, name, confidence, n_facts, n_sources, owner, website, first_source, last_source FROM concepts")
def x11f_concepts(t: Tables) -> DataFrame:
    facts = _facts(t)
    return O.concepts(facts, _conflicts(facts)).select("topic_key", "category", "name", "confidence", "n_facts", "n_sources", "owner", "website", "first_source", "last_source")


@query(f"WITH {CONCEPTS} SELECT topic_key, health, status, CASE status WHEN 'needs_attention' THEN 'high' WHEN 'strong' THEN 'low' ELSE 'medium' END AS priority, n_conflicts, array_to_string(missing, ',') AS missing FROM concepts")
def x11g_concept_health(t: Tables) -> DataFrame:
    facts = _facts(t)
    priority = F.when(F.col("status") == "needs_attention", "high").when(F.col("status") == "strong", "low").otherwise("medium")
    return O.concepts(facts, _conflicts(facts)).select("topic_key", "health", "status", priority.alias("priority"), "n_conflicts", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {CONCEPTS} SELECT topic_key, business, assistant, customer, importance, level, CASE level WHEN 'critical' THEN CASE WHEN conflicted THEN 'severe' ELSE 'high' END WHEN 'high' THEN 'high'
           WHEN 'medium' THEN CASE WHEN status = 'strong' AND NOT conflicted THEN 'low' ELSE 'moderate' END ELSE 'low' END AS risk FROM concepts""")
def x11h_concept_importance(t: Tables) -> DataFrame:
    facts = _facts(t)
    return O.concepts(facts, _conflicts(facts)).select("topic_key", "business", "assistant", "customer", "importance", "level", "risk")


@query(rf"""WITH {CONCEPTS}, rules(source_category, target_category, relation, connector) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in K.RELATIONS)}),
            named AS (SELECT topic_key, category, '(' || lower(name) || '|' || lower(replace(regexp_replace(topic_key, '^[^:]*:', ''), '_', ' ')) || ')' AS pattern FROM concepts),
            met AS (SELECT relation, a.topic_key AS source, b.topic_key AS target, f.* EXCLUDE (source), f.source AS doc FROM named a JOIN rules ON source_category = a.category JOIN named b ON b.category = target_category AND a.topic_key <> b.topic_key
                    JOIN facts f ON f.topic_key = a.topic_key AND explicit WHERE regexp_matches(value, '(?is)\b' || a.pattern || '\b.{{0,120}}?' || connector || '.{{0,120}}?\b' || b.pattern || '\b')),
            g AS (SELECT relation, source, target, round(avg(score))::INT AS mean, count(*) AS n_facts, count(DISTINCT CASE WHEN provenance = 'owner' THEN 'owner' ELSE doc END) AS n_sources, bool_or(provenance = 'owner') AS owner,
                         source IN (SELECT topic_key FROM conflicts) OR target IN (SELECT topic_key FROM conflicts) AS affected FROM met GROUP BY 1, 2, 3)
            SELECT relation, source, target, n_facts, n_sources, owner, affected, greatest(0, least(100, mean + CASE WHEN n_facts > 1 THEN 4 ELSE 0 END + CASE WHEN n_sources > 1 THEN 8 ELSE 0 END - CASE WHEN affected THEN 25 ELSE 0 END)) AS score FROM g""")
def x11i_relationships(t: Tables) -> DataFrame:
    facts = _facts(t)
    bad = _conflicts(facts)
    return O.relationships(facts, O.concepts(facts, bad), bad)


OWNER = _case([(_in("category", own), lit(owner)) for owner, own in K.OWNERS.items()], "'operations_context'")


def _reasons_sql() -> str:
    says = lambda name: R.is_match("value", K.CLAIMS[name])
    differs = "category IN ('competitive_differentiator', 'differentiator')"
    blob = f"len(regexp_extract_all(value, {lit(K.AMOUNT)})) >= 2 AND len(regexp_extract_all(value, {lit('(?i)' + K.ADD_ON)})) >= 2"
    pairs = [(f"owner = '{who}' AND len(lanes) > 0 AND NOT list_has_any(lanes, {list(own)!r})", lit(f"{who}_rejected_evidence_lane")) for who, own in K.LANES.items()]
    pairs += [
        (f"category IN ('location_service_area', 'location') AND NOT {says('area')}", "'requires_explicit_service_area_claim'"),
        (f"category IN ('company_overview', 'business_identity') AND ({says('call_to_act')} OR {says('advice')})", "'rejected_cta_or_advice'"),
        (f"owner = 'commercial' AND {says('policy')}", "'rejected_policy_language'"),
        (f"owner = 'commercial' AND {says('navigation')}", "'rejected_navigation_or_cta'"),
        (f"owner = 'commercial' AND {says('referral')} AND NOT list_contains(lanes, 'commercial')", "'rejected_referral_or_advice'"),
        (f"category IN ('pricing_plan', 'pricing') AND NOT {says('prices')} AND NOT ({says('money')} AND {says('dealing')})", "'requires_transactional_pricing'"),
        (f"category = 'service' AND list_contains(lanes, 'core_business') AND NOT {says('sells')}", "'requires_first_party_service_claim'"),
        (f"owner = 'market_customer' AND {says('teaching')}", "'rejected_educational_advice'"),
        (f"category IN ('customer_segment', 'customer') AND NOT ({says('audience')} AND {says('first_party')})", "'requires_first_party_customer_claim'"),
        (f"category = 'primary_use_case' AND NOT {says('use_case')}", "'requires_explicit_use_case'"),
        (f"{differs} AND {says('constraint')}", "'rejected_operational_constraint'"),
        (f"{differs} AND {blob}", "'rejected_pricing_blob_as_differentiator'"),
        (f"{differs} AND NOT {says('difference')} AND NOT {says('proof')}", "'requires_real_differentiation_or_authority'"),
        (f"category = 'additional_business_knowledge' AND NOT list_contains(lanes, 'proof') AND NOT {says('proof')}", "'requires_proof_signal'"),
    ]
    return _case(pairs, "NULL")


@query(f"WITH {FACTS}, owned AS (SELECT *, {OWNER} AS owner FROM facts) SELECT fact_id, category, owner, {_reasons_sql()} AS reason FROM owned")
def x9d_owner_reviews(t: Tables) -> DataFrame:
    c = F.col
    return _facts(t).select("fact_id", "category", O.owner_of(c("category")).alias("owner"), O.owner_review(c("category"), c("value"), c("lanes")).alias("reason"))

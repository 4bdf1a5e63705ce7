"""Reviewed knowledge: mappings, provenance, memory merges, serving projections, freshness and cutover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .graph import chains

#: Review category and entity type of each category of facts.
REVIEW_CATEGORY = {
    "pricing_plan": "pricing", "policy": "policy", "security_compliance": "policy", "customer_segment": "audience", "industry_served": "audience", "support_onboarding": "process",
    "competitive_differentiator": "differentiator", "product": "service", "service": "service", "feature_capability": "service", "primary_use_case": "service", "integration": "service",
    "ai_automation": "service", "technical_capability": "service",
}
ENTITY_TYPE = {
    "business_identity": "business", "product": "product", "service": "service", "customer": "customer_segment", "pricing": "pricing_concept", "policy": "policy", "process": "process", "faq": "faq",
    "differentiator": "differentiator", "guarantee": "guarantee", "location": "location", "contact": "contact_method", "other": "other", "feature_capability": "service", "pricing_plan": "pricing_concept",
    "customer_segment": "customer_segment", "industry_served": "customer_segment", "security_compliance": "policy", "support_onboarding": "process", "location_service_area": "location",
    "contact_information": "contact_method", "competitive_differentiator": "differentiator",
}
CATEGORIES = (
    "company_overview", "mission_value_proposition", "product", "service", "feature_capability", "pricing_plan", "customer_segment", "industry_served", "primary_use_case", "integration", "ai_automation",
    "technical_capability", "security_compliance", "certification", "support_onboarding", "partnership", "location_service_area", "contact_information", "brand_voice_terminology", "faq", "policy",
    "competitive_differentiator", "additional_business_knowledge", "business_identity", "industry", "customer", "pricing", "process", "differentiator", "guarantee", "location", "contact", "other",
)
PAGE_TYPES = (
    ("faq", "faq|frequently asked"), ("pricing", "pricing|price|package|plan"), ("services", "service|solution"), ("products", "product"),
    ("about", "about|company|story|team"), ("contact", "contact|get-in-touch|connect"), ("policy", "policy|terms|privacy|refund|return"),
)
LOW_SIGNAL = r"^(ok|okay|cool|yes|yep|sure|thanks|thank you|got it|nice|lol|maybe|hmm|wait|hold on)[.!?]*$"
PROJECTION_VERSION, SCHEMA_VERSION = 1, 1


def mapped(value: Column, names: dict[str, str], rest: str) -> Column:
    """A fixed mapping, with what all others become."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), value), F.lit(rest))


def page_type(path: Column, title: Column) -> Column:
    """X3d: the first kind whose words the path or title holds."""
    text = F.lower(F.concat_ws(" ", path, title))
    out = F.when(path.isin("/", ""), "home").otherwise("other")
    for name, p in reversed(PAGE_TYPES):
        out = F.when(text.rlike(p), name).otherwise(out)
    return out


def entity_name(value: Column) -> Column:
    """Trimmed, lower-cased, white space as one space. (Texts are taken as NFKC already.)"""
    return F.lower(T.clean(value))


def research_text(value: Column) -> Column:
    """Runs of blanks as one, at most one empty line; line ends are kept."""
    out = F.regexp_replace(F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n")), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def low_signal(value: Column) -> Column:
    """P20: whether a text is too short or a mere filler to change a memory."""
    text = F.lower(T.clean(value))
    return (F.length(text) < 4) | text.rlike(LOW_SIGNAL)


def provenance(status: Column, source: Column, block: Column, url: Column, excerpt: Column, generated: Column, edited: Column, saved: Column) -> Column:
    """Who a context entry comes from: what was saved, else corrections, else the shape of its source."""
    website = (source == "website") & (block == "website_knowledge") & (F.length(F.coalesce(url, F.lit(""))) > 0) & (F.length(F.coalesce(excerpt, F.lit(""))) > 0)
    shape = F.when(website, "website").when(generated | (source == "generated_qa"), "ai_generated").when(source == "manual_intake", "manual").otherwise("ai_generated")
    known = saved.isin("manual", "website", "ai_generated", "user_corrected")
    return F.when(known, saved).when((status == "corrected") | (source == "user_edit") | edited, "user_corrected").otherwise(shape)


def availability(exact: Column, n_source: Column, n_evidence: Column) -> Column:
    """How far an entry's origin can be shown."""
    return F.when(exact & (n_source > 0) & (n_evidence > 0), "exact").when((n_source > 0) | (n_evidence > 0), "partial").otherwise("classification_only")


def merge_entries(current: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each incoming row as added, updated or skipped, and whether that archives it. ``fields`` include status."""
    old = current.select(key, *(F.col(f).alias(f"old_{f}") for f in fields), F.lit(True).alias("known"))
    both = incoming.join(old, key, "left")
    same = F.lit(True)
    for f in fields:
        same &= F.col(f).eqNullSafe(F.col(f"old_{f}"))
    known = F.coalesce("known", F.lit(False))
    change = F.when(~F.coalesce(F.col("status").isin("approved", "corrected", "archived"), F.lit(False)), "skipped").when(~known, "added").when(same, "skipped").otherwise("updated")
    both = both.withColumn("change", change)
    archives = (F.col("change") != "skipped") & (F.col("status") == "archived") & ~(known & F.col("old_status").eqNullSafe(F.lit("archived")))
    return both.select(key, "change", archives.alias("archives"))


def stale_reasons(record: str, now: str) -> Column:
    """Why a stored projection may not be served; ``record`` and ``now`` prefix the columns."""
    checks = (
        (~F.col(f"{record}fingerprint").eqNullSafe(F.col(f"{now}fingerprint")), "fingerprint_mismatch"),
        (F.col(f"{record}version") != PROJECTION_VERSION, "projection_version_mismatch"),
        (F.col(f"{record}schema") != SCHEMA_VERSION, "schema_version_mismatch"),
        (F.col(f"{record}state") != "valid", "invalidation_state"),
    )
    return F.array_join(F.array_compact(F.array(*(F.when(test, reason) for test, reason in checks))), ",")


def cutover_failure() -> Column:
    """The first reason against serving a projection, or null.

    Columns: authority, has_evidence, parity, evidence_authority, state, evidence_version, version,
    evidence_schema, schema, evidence_fingerprint, fingerprint, compared, generated.
    """
    c = F.col
    runtime = "assistant_projection_runtime_unavailable_"
    checks = (
        (~c("authority").eqNullSafe(F.lit("canonical")), F.lit("assistant_projection_migration_required")),
        (~c("has_evidence"), F.lit(runtime + "parity_evidence_unavailable")),
        (~c("parity").eqNullSafe(F.lit("MATCH")), F.lit(runtime + "parity_status_unacceptable")),
        (~c("evidence_authority").eqNullSafe(c("authority")), F.lit(runtime + "parity_authority_mismatch")),
        (c("state") != "valid", F.concat(F.lit(runtime), "state")),
        (~c("evidence_version").eqNullSafe(c("version")) | ~c("evidence_schema").eqNullSafe(c("schema")), F.lit(runtime + "parity_evidence_stale")),
        (F.coalesce(c("evidence_fingerprint") == "", F.lit(True)) | ~c("evidence_fingerprint").eqNullSafe(c("fingerprint")), F.lit(runtime + "parity_evidence_fingerprint_mismatch")),
        (F.coalesce(c("compared") < c("generated"), F.lit(True)), F.lit(runtime + "parity_evidence_stale")),
    )
    out = F.lit(None).cast("string")
    for test, reason in reversed(checks):
        out = F.when(test, reason).otherwise(out)
    return out


def refusals(assertions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Projects that may not be projected: with an open conflict, or without a clear successor.

    ``assertions``: project, id, state, predecessor. A predecessor must exist; a correction follows a
    reviewed one; of the successors of an assertion at most one is approved or corrected; an
    assertion with such a successor, or a proposed one, may not be active itself; and predecessors
    may not form a cycle, which refuses its own project only.
    """
    c = F.col
    live = c("state").isin("approved", "corrected")
    linked = assertions.where("predecessor is not null")
    before = assertions.select("project", c("id").alias("predecessor"), c("state").alias("before"))
    linked = linked.join(before, ["project", "predecessor"], "left")
    unclear = linked.where(c("before").isNull() | ((c("state") == "corrected") & ~c("before").isin("approved", "corrected", "superseded", "archived"))).select("project")
    by = linked.groupBy("project", "predecessor").agg(F.count_if(live).alias("n"), F.bool_or(live | (c("state") == "proposed")).alias("next"), F.first("before").alias("before"))
    unclear = unclear.union(by.where((c("n") > 1) | (c("next") & c("before").isin("approved", "corrected"))).select("project"))
    cycles = chains(linked.select("project", c("id").alias("src"), c("predecessor").alias("dst"))).where("cyclic")
    unclear = unclear.union(cycles.select("project"))
    bad = conflicts.where("not resolved").select("project", F.lit("assistant_projection_unresolved_conflict").alias("code"))
    return bad.union(unclear.select("project", F.lit("assistant_projection_unresolved_revision_authority").alias("code"))).groupBy("project").agg(F.min("code").alias("code"))


def projection(assertions: DataFrame, entities: DataFrame, merges: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The items a project may serve: approved or corrected assertions under their merged entity.

    ``entities``: project, entity, type, name; ``merges``: merged entity and its survivor (``src``, ``dst``), ids being those of all projects. Items of an
    entity whose merges lead into a cycle are left out; other items and projects are served.
    """
    final = chains(merges.select(F.lit(0).alias("project"), "src", "dst")).select(F.col("src").alias("entity"), F.col("dst").alias("canonical"), "cyclic")
    named = entities.join(final, "entity", "left").where("not coalesce(cyclic, false)").select("project", "entity", "type", "name", F.coalesce("canonical", "entity").alias("canonical"))
    own = assertions.where(F.col("state").isin("approved", "corrected")).join(refusals(assertions, conflicts), "project", "left_anti")
    return own.join(named, ["project", "entity"]).select("project", "id", F.col("canonical").alias("entity"), "type", F.col("name").alias("title"), "value", "state", "predecessor")


#: What of a text says that a thing is so or its opposite.
UNAVAILABLE = r"\b(?:do not|don't|does not|doesn't|no)\s+(?:offer|provide|have|allow)\b|\b(?:not available|unavailable)\b"
AVAILABLE = r"\b(?:available|offer|offers|offered|provide|provides|provided|allow|allows|allowed)\b"
EXTRA = r"\b(?:costs?|charges?|priced?)\s+(?:extra|additional)\b|\b(?:extra|additional)\s+(?:cost|charge|fee)\b|\bnot included\b"
INCLUDED = r"\bincluded\b|\bat no additional cost\b"
FACTUAL = ("decision", "clarification", "summary", "current_task")


def polarities(text: Column) -> Column:
    """Signs of what a text claims: availability, opening and cost, positive or negative."""
    low = F.lower(text)
    off, extra = T.matches(low, UNAVAILABLE), T.matches(low, EXTRA)
    return F.array_compact(F.array(
        F.when(off, "-available").when(T.matches(low, AVAILABLE), "+available"), F.when(T.matches(low, r"\bclosed\b"), "-open"), F.when(T.matches(low, r"\bopen\b"), "+open"),
        F.when(extra, "-included").when(T.matches(low, INCLUDED), "+included"),
    ))


def subject_terms(text: Column) -> Column:
    """Words of three or more characters without their plural ending."""
    return F.array_distinct(F.transform(T.tokens(text, 3), lambda w: F.regexp_replace(F.regexp_replace(w, "ies$", "y"), "s$", "")))


def contradicted(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Remembered items (item_id, thread, category, content) that a fact (thread, value) contradicts.

    Items and facts of a thread meet on a shared word, for numbers, or a shared subject, for
    opposite claims; each carries its numbers or signs along.
    """
    number = r"\d+(?:\.\d+)?"
    nums = lambda x: F.regexp_extract_all(x, F.lit(number), F.lit(0))
    opposite = lambda x: F.transform(x, lambda s: F.concat(F.when(s.startswith("-"), "+").otherwise("-"), F.substring(s, 2, 99)))
    a = items.select("item_id", "thread", nums(F.col("content")).alias("n"), T.tokens(F.col("content"), 3).alias("words"), F.when(F.col("category").isin(*FACTUAL), polarities(F.col("content"))).otherwise(F.array()).alias("signs"), subject_terms(F.col("content")).alias("terms"))
    b = facts.select("thread", nums(F.col("value")).alias("fn"), T.tokens(F.col("value"), 3).alias("fwords"), opposite(polarities(F.col("value"))).alias("fsigns"), subject_terms(F.col("value")).alias("fterms"))
    by_number = a.where(F.size("n") > 0).withColumn("word", F.explode("words")).join(b.where(F.size("fn") > 0).withColumn("word", F.explode("fwords")), ["thread", "word"]).where(F.size(F.array_except("n", "fn")) > 0)
    by_sign = a.where(F.size("signs") > 0).withColumn("term", F.explode("terms")).join(b.where(F.size("fsigns") > 0).withColumn("term", F.explode("fterms")), ["thread", "term"]).where(F.arrays_overlap("signs", "fsigns"))
    return by_number.select("thread", "item_id").union(by_sign.select("thread", "item_id")).distinct()


def best_evidence(links: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most used evidence rows by (uses, captured, has excerpt, id)."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("uses").desc(), F.col("captured").desc(), F.col("has_excerpt").desc(), "evidence"))
    return links.withColumn("n", n).where(F.col("n") <= k)

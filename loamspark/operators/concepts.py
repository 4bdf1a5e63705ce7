"""Concepts over scored facts: health, importance, relationships; and the owners that accept facts.

Facts have fact_id, category, topic_key, title, value, score, provenance, source, lanes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import concept_rules as K
from ..functions import text as T


def display_name(topic: Column) -> Column:
    """A label from the identity of a topic alone."""
    has_space = F.instr(topic, ":") > 0
    namespace = F.when(has_space, F.substring_index(topic, ":", 1)).otherwise("")
    identity = F.when(has_space, F.regexp_replace(topic, "^[^:]*:", "")).otherwise(topic)
    acronyms = F.create_map(*(F.lit(x) for kv in K.ACRONYMS.items() for x in kv))
    words = F.filter(F.split(identity, "_"), lambda w: w != "")
    named = F.transform(words, lambda w: F.coalesce(F.try_element_at(acronyms, F.lower(w)), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))))
    base = F.when(F.size(words) > 0, F.array_join(named, " ")).otherwise("Unknown")
    out = base
    for space, suffix in K.SUFFIXES.items():
        out = F.when((namespace == space) & ~F.lower(base).endswith(" " + suffix.lower()), F.concat(base, F.lit(" " + suffix))).otherwise(out)
    return out


def concepts(facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """X11f, X11g, X11h, A5: a row for each topic of a concept category; ``conflicts`` has topic_key and n.

    All that health and importance ask of the statements is whether some statement matches, so
    facts are aggregated before they are shuffled and never gathered.
    """
    said = lambda p, fold: F.bool_or(T.matches(F.col("value"), p, fold))
    words = F.concat_ws(" ", F.regexp_replace("topic_key", "[_:]", " "), "title", "value")
    signals = [F.when(F.first("category") == c, said(p, fold)).alias(f"has_{c}_{name}") for c, name, p, fold in K.SIGNALS]
    wording = [F.bool_or(T.matches(words, p)).alias(f"is_{name}") for name, p in K.WORDING.items()]
    out = facts.where(F.col("category").isin(*K.BASELINES)).groupBy("topic_key").agg(
        F.min("category").alias("category"), F.round(F.avg("score")).cast("int").alias("confidence"), F.count("*").alias("n_facts"),
        F.countDistinct(F.when(F.col("provenance") == "owner", "owner").otherwise(F.col("source"))).alias("n_sources"),
        F.bool_or(F.col("provenance") == "owner").alias("owner"), F.bool_or(F.col("provenance") == "website").alias("website"),
        F.min("source").alias("first_source"), F.max("source").alias("last_source"), *signals, *wording,
    )
    out = out.join(conflicts.select("topic_key", F.col("n").alias("n_conflicts")), "topic_key", "left").fillna(0, ["n_conflicts"])
    c = F.col
    missing = F.array_compact(F.array(*(F.when((c("category") == own) & ~c(f"has_{own}_{name}"), name) for own, name, _, _ in K.SIGNALS)))
    out = out.withColumns({"name": display_name(c("topic_key")), "missing": missing, "conflicted": c("n_conflicts") > 0, "mixed": c("owner") & c("website")})
    support = F.when(c("n_sources") >= 2, 8).when(c("n_sources") == 1, -10).otherwise(-20)
    health = c("confidence") + support + F.when(c("n_facts") >= 2, 4).otherwise(0) + F.when(c("mixed") & ~c("conflicted"), 6).otherwise(0)
    health = F.greatest(F.lit(0), F.least(F.lit(100), health - F.least(F.lit(45), c("n_conflicts") * 30) - F.least(F.lit(12), F.size("missing") * 4)))
    out = out.withColumn("health", health.cast("int"))
    status = F.when(c("conflicted") | (c("confidence") < 52) | (c("health") < 50), "needs_attention")
    status = status.when((c("health") >= 75) & (c("n_sources") >= 2) & (F.size("missing") == 0), "strong").otherwise("review_recommended")
    for i, side in enumerate(("business", "assistant", "customer")):
        score = F.lit(20)
        for own, base in K.BASELINES.items():
            score = F.when(c("category") == own, base[i]).otherwise(score)
        for name, own, kind, amounts in K.ADJUSTMENTS:
            counts = c(f"is_{name}") & (c("category").isin(*own) if own else F.lit(True))
            score = F.when(counts, score + amounts[i] if kind == "add" else F.greatest(score, F.lit(amounts[i]))).otherwise(score)
        out = out.withColumn(side, F.greatest(F.lit(0), F.least(F.lit(100), score)))
    total = sum((c(side) * F.lit(share) for side, share in zip(("business", "assistant", "customer"), K.SHARES, strict=True)), F.lit(0.0))
    out = out.withColumns({"status": status, "importance": F.round(total).cast("int")})
    level = F.when(c("importance") >= 85, "critical").when(c("importance") >= 70, "high").when(c("importance") >= 45, "medium").otherwise("low")
    risk = F.when(c("level") == "critical", F.when(c("conflicted"), "severe").otherwise("high")).when(c("level") == "high", "high")
    risk = risk.when(c("level") == "medium", F.when((c("status") == "strong") & ~c("conflicted"), "low").otherwise("moderate")).otherwise("low")
    return out.withColumn("level", level).withColumn("risk", risk).drop(*[f"has_{a}_{b}" for a, b, _, _ in K.SIGNALS], *[f"is_{w}" for w in K.WORDING])


def _squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def relationships(facts: DataFrame, found: DataFrame, conflicts: DataFrame) -> DataFrame:
    """X11i, A6, J8: relations that a fact of the source states: its name, the connecting words, the name of the target.

    A statement is a fact's title, its value or one of its ``excerpts`` (an array, if facts have that column). It meets the
    rules of its fact's category, then the names of its own concept and those of targets, each name by its rarest word, so
    pairs of concepts arise only where a statement may name both, however long the names are.
    """
    named = facts.join(found.select("topic_key", "name"), "topic_key")
    identity = F.regexp_replace(F.regexp_replace("topic_key", "^[^:]*:?", ""), "_", " ")
    names = F.filter(F.array_distinct(F.array(T.key_text(F.col("name")), T.key_text(identity), T.key_text(F.col("title")))), lambda x: F.length(x) >= 2)
    own = named.select("topic_key", "category", F.explode(names).alias("called")).distinct().withColumn("plain", _squashed(F.col("called")))
    words = own.withColumn("word", F.explode(F.array_distinct(F.split("plain", " "))))
    times = words.groupBy("word").agg(F.count("*").alias("n"))
    rare = words.join(times, "word").groupBy("topic_key", "category", "called", "plain").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    rules = facts.sparkSession.createDataFrame(K.RELATIONS, "category string, target_category string, relation string, connector string")
    excerpts = F.coalesce("excerpts", F.array()) if "excerpts" in facts.columns else F.array().cast("array<string>")
    said = facts.where("explicit").withColumn("statement", F.explode(F.array_distinct(F.concat(F.array("title", "value"), excerpts))))
    said = said.join(F.broadcast(rules), "category").where(F.expr("statement rlike concat('(?i)', connector)")).withColumn("told", _squashed(F.col("statement")))
    said = said.withColumn("words", F.array_distinct(F.concat(F.split("told", " "), F.array(F.lit("")))))  # a name of symbols alone has no word
    of = rare.select("topic_key", "word", F.col("called").alias("source_name"), F.col("plain").alias("source_plain"))
    met = said.withColumn("word", F.explode("words")).join(of, ["topic_key", "word"]).where(F.contains("told", "source_plain")).drop("word")
    to = rare.select(F.col("topic_key").alias("target"), F.col("category").alias("target_category"), "word", F.col("called").alias("target_name"), F.col("plain").alias("target_plain"))
    met = met.withColumn("word", F.explode("words")).join(to, ["target_category", "word"]).where(F.contains("told", "target_plain") & (F.col("topic_key") != F.col("target")))
    pattern = lambda x: F.concat(F.lit(r"(?<![a-z0-9])"), F.regexp_replace(F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1"), " ", r"\\s+"), F.lit(r"(?![a-z0-9])"))
    met = met.withColumns({"source_name": pattern("source_name"), "target_name": pattern("target_name")})
    met = met.where(F.expr(r"statement rlike concat('(?is)', source_name, '.{0,120}?', connector, '.{0,120}?', target_name)"))
    met = met.drop("words", "word", "statement", "told", "source_name", "source_plain", "target_name", "target_plain").distinct()
    source = F.when(F.col("provenance") == "owner", "owner").otherwise(F.col("source"))
    out = met.groupBy("relation", F.col("topic_key").alias("source"), "target").agg(F.round(F.avg("score")).cast("int").alias("mean"), F.count("*").alias("n_facts"), F.countDistinct(source).alias("n_sources"), F.bool_or(F.col("provenance") == "owner").alias("owner"))
    bad = conflicts.select("topic_key").distinct()
    out = out.join(bad.select(F.col("topic_key").alias("source"), F.lit(True).alias("bad_source")), "source", "left").join(bad.select(F.col("topic_key").alias("target"), F.lit(True).alias("bad_target")), "target", "left")
    affected = F.coalesce("bad_source", "bad_target", F.lit(False))
    score = F.col("mean") + F.when(F.col("n_facts") > 1, 4).otherwise(0) + F.when(F.col("n_sources") > 1, 8).otherwise(0) - F.when(affected, 25).otherwise(0)
    return out.select("relation", "source", "target", "n_facts", "n_sources", "owner", affected.alias("affected"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"))


def owner_of(category: Column) -> Column:
    """X9d: who owns facts of a category."""
    out = F.lit("operations_context")
    for owner, own in K.OWNERS.items():
        out = F.when(category.isin(*own), owner).otherwise(out)
    return out


def owner_review(category: Column, value: Column, lanes: Column) -> Column:
    """Why an owner turns a fact down, or null if it accepts it. ``lanes`` are those of its evidence."""
    value = F.trim(value)
    says = {name: T.matches(value, p) for name, p in K.CLAIMS.items()}
    owner = owner_of(category)

    def foreign(who: str) -> Column:
        return (owner == who) & (F.size(lanes) > 0) & ~F.arrays_overlap(lanes, F.array(*map(F.lit, K.LANES[who])))

    blob = (F.regexp_count(value, F.lit(K.AMOUNT)) >= 2) & (F.regexp_count(value, F.lit("(?i)" + K.ADD_ON)) >= 2)
    proof_lane = F.array_contains(lanes, "proof")
    checks = [(foreign(who), f"{who}_rejected_evidence_lane") for who in K.LANES]
    checks += [
        (category.isin("location_service_area", "location") & ~says["area"], "requires_explicit_service_area_claim"),
        (category.isin("company_overview", "business_identity") & (says["call_to_act"] | says["advice"]), "rejected_cta_or_advice"),
        ((owner == "commercial") & says["policy"], "rejected_policy_language"),
        ((owner == "commercial") & says["navigation"], "rejected_navigation_or_cta"),
        ((owner == "commercial") & says["referral"] & ~F.array_contains(lanes, "commercial"), "rejected_referral_or_advice"),
        (category.isin("pricing_plan", "pricing") & ~says["prices"] & ~(says["money"] & says["dealing"]), "requires_transactional_pricing"),
        ((category == "service") & F.array_contains(lanes, "core_business") & ~says["sells"], "requires_first_party_service_claim"),
        ((owner == "market_customer") & says["teaching"], "rejected_educational_advice"),
        (category.isin("customer_segment", "customer") & ~(says["audience"] & says["first_party"]), "requires_first_party_customer_claim"),
        ((category == "primary_use_case") & ~says["use_case"], "requires_explicit_use_case"),
        (category.isin("competitive_differentiator", "differentiator") & says["constraint"], "rejected_operational_constraint"),
        (category.isin("competitive_differentiator", "differentiator") & blob, "rejected_pricing_blob_as_differentiator"),
        (category.isin("competitive_differentiator", "differentiator") & ~says["difference"] & ~says["proof"], "requires_real_differentiation_or_authority"),
        ((category == "additional_business_knowledge") & ~proof_lane & ~says["proof"], "requires_proof_signal"),
    ]
    out = F.lit(None).cast("string")
    for test, reason in reversed(checks):
        out = F.when(test, reason).otherwise(out)
    return out

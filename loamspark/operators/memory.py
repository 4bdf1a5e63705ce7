"""The memory graph: build, incremental rebuild, desired state, drift, typed repairs and merges.

A memory is a set of tables: entities, aliases, assertions, sources, evidence, relationships, conflicts, missing, and
the links of assertions to sources and evidence and of conflicts to assertions. Links are tables rather than arrays, so
that an entity with a third of all assertions stays one row of each table it is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..session import shuffled, stored
from .graph import chains, components
from .knowledge import ENTITY_TYPE, mapped

c = F.col

#: The entity types of review categories.
REVIEW_TYPE = {
    "business_profile": "business", "audience": "customer_segment", "service": "service", "pricing": "pricing_concept", "policy": "policy", "process": "process",
    "differentiator": "differentiator", "faq": "faq", "behavior_rule": "other", "prohibited_claim": "other",
}
#: Website categories without an entity type of their own; what is in neither table is of type other.
GENERAL = (
    "company_overview", "mission_value_proposition", "industry", "primary_use_case", "integration", "ai_automation", "technical_capability", "certification", "partnership",
    "brand_voice_terminology", "additional_business_knowledge",
)
WEBSITE_TYPE = ENTITY_TYPE | dict.fromkeys(GENERAL, "general_knowledge")
#: The scores of levels of confidence.
LEVEL_SCORE = {"high": 0.9, "medium": 0.7}


# --- X35: build --------------------------------------------------------------------------


def _origin(entry: str = "") -> Column:
    kind = c(f"{entry}source_type")
    return F.when((kind == "user_edit") | c(f"{entry}user_edited"), "user_edit").when(kind == "website", "website").when(kind == "generated_qa", "generated_qa").otherwise("manual_intake")


def _tags(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(x, T.clean), lambda t: t != "")))


def fact_material(*evidence: str) -> Column:
    """What identifies a website fact: category, title, value and the given fields of its evidence, sorted."""
    each = F.transform("evidence", lambda e: T.merge_value(F.concat_ws("\x00", *(F.coalesce(e[f], F.lit("")) for f in evidence))))
    return F.array_join(F.concat(F.array(*map(T.merge_value, (c("category"), c("title"), c("value")))), F.array_sort(F.filter(each, lambda x: x != ""))), "\x00")


def legacy_rows(s: dict[str, DataFrame]) -> DataFrame:
    """Entries, FAQs and website facts in one shape; facts that an entry restores give that entry its evidence."""
    short = F.regexp_replace(T.stable_id("x", fact_material("url"), padded=False), "^x_", "")
    facts = s["facts"].withColumn("short", short)
    named = F.array(F.concat(F.lit("website_fact_"), c("short")), F.concat(F.lit("website_fact_"), T.merge_value(c("project")), F.lit("_"), c("short")))
    named = facts.select("project", "short", F.explode(named).alias("id"), F.struct("category", "evidence").alias("fact"))
    ids = named.groupBy("project", "id").agg(F.max("fact").alias("fact"))
    restored = named.select("project", "id", "short").join(s["entries"].select("project", "id"), ["project", "id"], "left_semi").select("project", "short")
    site = s["crawls"].select("project", c("attempt").alias("attempt"), c("url").alias("site"), "imported")
    web = c("origin") == "website"

    entries = s["entries"].join(ids, ["project", "id"], "left").join(s["labels"], ["project", "block"], "left").withColumn("origin", _origin())
    entries = entries.join(site.drop("site"), "project", "left")
    excerpt = F.when(T.clean(c("excerpt")) != "", F.array(F.struct(c("url"), c("excerpt"), F.lit(None).cast("string").alias("document"), F.lit(None).cast("string").alias("block"))))
    key = F.concat_ws(":", F.when(web, "website-restored").otherwise("context"), F.coalesce("fact.category", "category"), T.merge_value(c("title")))
    authority = F.when(c("status") == "corrected", "corrected").when(c("user_edited"), "confirmed").when(c("origin") == "generated_qa", "generated").when(web, "observed").otherwise("provided")
    none = F.lit(None).cast("string")
    entries = entries.select(
        "project", F.lit("context").alias("kind"), c("id").alias("identity"), c("id").alias("legacy_id"), key.alias("entity_key"),
        F.when(c("fact").isNotNull(), mapped(c("fact.category"), WEBSITE_TYPE, "other")).otherwise(mapped(c("category"), REVIEW_TYPE, "other")).alias("type"),
        T.clean(c("title")).alias("name"), T.clean(c("content")).alias("value"), _tags(c("tags")).alias("tags"), "confidence", c("score").cast("double").alias("score"), c("status").alias("review"), authority.alias("authority"),
        "origin", c("id").alias("source_entry"), F.when(c("block") != "", c("block")).alias("block"), "url", "label", c("created").alias("captured"), F.when(web, c("attempt")).alias("attempt"), F.when(web, c("imported")).alias("imported"),
        F.coalesce("fact.evidence", excerpt, F.array()).alias("evidence"), "created", "updated", F.array().cast("array<string>").alias("supports"),
    )
    faqs = s["faqs"].select(
        "project", F.lit("faq").alias("kind"), c("id").alias("identity"), c("id").alias("legacy_id"), F.concat(F.lit("faq:"), c("id")).alias("entity_key"), F.lit("faq").alias("type"),
        T.clean(c("question")).alias("name"), T.clean(c("answer")).alias("value"), F.array(F.lit("faq")).alias("tags"), "confidence", c("score").cast("double").alias("score"), c("status").alias("review"),
        F.when(c("status") == "corrected", "corrected").otherwise("generated").alias("authority"), F.lit("generated_qa").alias("origin"), c("id").alias("source_entry"), none.alias("block"), none.alias("url"),
        F.lit("Generated FAQ").alias("label"), c("created").alias("captured"), none.alias("attempt"), none.alias("imported"), F.array().cast(entries.schema["evidence"].dataType).alias("evidence"), "created", "updated", _tags(c("sources")).alias("supports"),
    )
    # Facts of one fingerprint are numbered, in order of how they are written; equal ones are counted first.
    known = facts.join(restored, ["project", "short"], "left_anti")
    variant = ["title", "value", "confidence", "category", "evidence"]
    known = known.withColumn("fingerprint", fact_material("url", "excerpt")).groupBy("project", "fingerprint", *variant).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("project", "fingerprint").orderBy(*variant).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = known.withColumn("before", before).withColumn("nth", F.explode(F.sequence(c("before"), c("before") + c("n") - 1))).join(site, "project", "left")
    level = F.create_map(*(F.lit(x) for pair in LEVEL_SCORE.items() for x in pair))
    facts = known.select(
        "project", F.lit("website").alias("kind"), T.sha_id("website_fact", c("fingerprint"), c("nth").cast("string")).alias("identity"), none.alias("legacy_id"),
        F.concat_ws(":", F.lit("website"), "category", T.merge_value(c("title"))).alias("entity_key"), mapped(c("category"), WEBSITE_TYPE, "other").alias("type"),
        T.clean(c("title")).alias("name"), T.clean(c("value")).alias("value"), F.array("category").alias("tags"), "confidence", F.coalesce(F.element_at(level, c("confidence")), F.lit(0.5)).alias("score"),
        F.lit("proposed").alias("review"), F.lit("observed").alias("authority"), F.lit("website").alias("origin"), none.alias("source_entry"), F.lit("website_knowledge").alias("block"), c("site").alias("url"), c("site").alias("label"),
        F.coalesce("imported", F.lit("")).alias("captured"), "attempt", "imported", "evidence", F.coalesce("imported", F.lit("")).alias("created"), F.coalesce("imported", F.lit("")).alias("updated"), F.array().cast("array<string>").alias("supports"),
    )
    return entries.unionByName(faqs).unionByName(facts)


def build(s: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of the memories of all projects.

    Input tables: ``entries`` (project, id, category, title, content, tags, confidence, score, status, source_type, user_edited, block, url,
    excerpt, created, updated), ``faqs`` (project, id, question, answer, confidence, score, status, sources, created, updated), ``facts``
    (project, category, title, value, confidence, evidence: url, excerpt, document, block), ``crawls`` (project, attempt, url, imported),
    ``pages`` (project, url, page_type), ``labels`` (project, block, label), ``conflicts`` (project, id, topic, first, second, resolved),
    ``missing`` (project, id, topic, reason, resolved). Times are ISO texts. Crawls, labels and pages have unique keys.
    """
    rows = legacy_rows(s)
    rows = rows.withColumns({"entity_id": T.sha_id("business_entity", c("project"), c("type"), c("entity_key")), "assertion_id": T.sha_id("business_assertion", c("project"), c("kind"), c("identity"))})
    assertions = rows.select("project", c("assertion_id").alias("id"), "entity_id", "value", "confidence", "score", "review", "authority", "tags", "legacy_id", "created", "updated")

    reviewed = c("review").isin("approved", "corrected")
    priority = F.when(reviewed & (c("origin") == "user_edit"), 0).when(reviewed & (c("origin") == "manual_intake"), 1).when(reviewed, 2).otherwise(3)
    named = rows.where("name <> ''").groupBy("project", "entity_id", F.lower("name").alias("norm")).agg(F.min(F.struct(priority.alias("p"), "name")).alias("best"))
    aliases = named.select("project", "entity_id", c("best.name").alias("alias"))
    name = named.groupBy("project", "entity_id").agg(F.min("best").alias("best"))
    entities = rows.groupBy("project", "entity_id").agg(F.min("type").alias("type"), F.count("*").alias("n_assertions"), F.min("created").alias("created"), F.max("updated").alias("updated"))
    entities = entities.join(name, ["project", "entity_id"], "left").select("project", c("entity_id").alias("id"), "type", F.coalesce("best.name", F.lit("")).alias("name"), "n_assertions", "created", "updated")

    own = rows.select("project", "assertion_id", "origin", "source_entry", "block", "url", "label", "attempt", "captured", "imported", "created", F.explode_outer("evidence").alias("e"))
    own = own.withColumns({"url": F.coalesce("e.url", "url"), "document": c("e.document"), "shown": c("e").isNotNull()})
    own = own.join(s["pages"].select("project", "url", "page_type"), ["project", "url"], "left")
    parts = ("project", "assertion_id", "origin", "source_entry", "block", "url", "label", "attempt", "document", "captured", "imported", "page_type")
    own = own.withColumn("source_id", T.sha_id("knowledge_source", *map(c, parts)))
    own = own.withColumn("evidence_id", F.when(c("shown"), T.sha_id("evidence", c("source_id"), c("e.url"), c("e.excerpt"), c("e.block"), c("created"))))
    sources = own.select("project", c("source_id").alias("id"), *parts[2:]).distinct()
    evidence = own.where("shown").groupBy("project", c("evidence_id").alias("id")).agg(F.min("source_id").alias("source_id"), F.min(T.clean(c("e.excerpt"))).alias("excerpt"), F.min("e.url").alias("url"), F.min("created").alias("captured"), F.min("e.block").alias("block"))

    by_legacy = rows.where("legacy_id is not null").groupBy("project", "legacy_id").agg(F.max_by(F.struct("entity_id", "assertion_id"), "kind").alias("to"))
    support = rows.where("kind = 'faq'").select("project", "review", "created", "updated", c("legacy_id").alias("faq"), F.explode("supports").alias("legacy_id"))
    support = support.join(by_legacy.withColumnRenamed("to", "a"), ["project", "legacy_id"]).join(by_legacy.select("project", c("legacy_id").alias("faq"), c("to").alias("b")), ["project", "faq"])
    relationships = support.select(
        "project", T.sha_id("business_relationship", F.lit("supports"), c("a.entity_id"), c("b.entity_id"), c("legacy_id"), c("faq")).alias("id"), F.lit("supports").alias("kind"),
        c("a.entity_id").alias("a"), c("b.entity_id").alias("b"), c("a.assertion_id").alias("from_assertion"), c("b.assertion_id").alias("to_assertion"), "review", "created", "updated",
    )

    conflicts = s["conflicts"].withColumn("conflict_id", T.sha_id("business_memory_conflict", c("project"), c("id")))
    said = conflicts.select("project", "conflict_id", F.explode(F.array_distinct(F.transform(F.array("first", "second"), T.merge_value))).alias("norm"))
    heard = rows.select("project", "assertion_id", F.explode(F.array_distinct(F.array(F.lower("value"), F.lower("name")))).alias("norm"))
    return {
        "entities": entities, "aliases": aliases, "assertions": assertions, "sources": sources, "evidence": evidence, "relationships": relationships,
        "assertion_sources": own.select("project", "assertion_id", "source_id").distinct(),
        "assertion_evidence": own.where("shown").select("project", "assertion_id", "evidence_id").distinct(),
        "conflicts": conflicts.select("project", c("conflict_id").alias("id"), "topic", _tags(F.array("first", "second")).alias("statements"), "resolved"),
        "conflict_assertions": said.join(heard, ["project", "norm"]).select("project", "conflict_id", "assertion_id").distinct(),
        "missing": s["missing"].select("project", T.sha_id("business_memory_missing_information", c("project"), c("id")).alias("id"), "topic", "reason", "resolved"),
    }


# --- order-free fingerprints, X35b, X46 --------------------------------------------------


def row_digest(df: DataFrame, *but: str) -> Column:
    """md5 of a row's values, but the columns named, in order of name; null differs from an empty text."""
    values = [F.coalesce(c(n).cast("string") if not t.startswith(("array", "struct")) else F.to_json(n), F.lit("\x00")) for n, t in sorted(df.dtypes) if n not in but]
    return F.md5(F.concat_ws("\x1f", *values).cast("binary"))


def _sum_of(part: Column) -> Column:
    return F.sum(F.conv(part, 16, 10).cast("decimal(20,0)"))


def state_fingerprints(models: dict[str, DataFrame]) -> DataFrame:
    """Project and fingerprint of nested sets of rows, in whatever order they are.

    Each row's digest counts as two numbers of 60 bits, whose sums by project Spark combines before the shuffle.
    """
    out = None
    for name, df in models.items():
        rows = df.select("project", F.md5(F.concat_ws("\x1f", F.lit(name), row_digest(df, "project")).cast("binary")).alias("digest"))
        out = rows if out is None else out.unionByName(rows)
    sums = out.groupBy("project").agg(F.count("*").alias("n"), _sum_of(F.substring("digest", 1, 15)).alias("s"), _sum_of(F.substring("digest", 16, 15)).alias("t"))
    return sums.select("project", F.sha2(F.concat_ws("|", *(c(x).cast("string") for x in "nst")), 256).alias("fingerprint"))


def rebuild_plan(state: DataFrame, now: DataFrame, force: bool = False) -> DataFrame:
    """What becomes of each project's memory.

    ``state``: project, revision, fingerprint, trusted_revision of the stored memories; ``now``: project, fingerprint,
    trusted_revision of the present inputs. Actions: ``create``, ``rebuild`` (the material changed: the revision grows),
    ``reconstruct`` (forced; the revision stays), ``refresh`` (only the trusted revision moved), ``keep``, and ``drop``.
    """
    both = now.select("project", c("fingerprint").alias("want"), c("trusted_revision").alias("trusted")).join(state, "project", "full_outer")
    action = F.when(c("want").isNull(), "drop").when(c("fingerprint").isNull(), "create").when(c("want") != c("fingerprint"), "rebuild").when(F.lit(force), "reconstruct")
    action = action.when(~c("trusted").eqNullSafe(c("trusted_revision")), "refresh").otherwise("keep")
    revision = F.when(c("fingerprint").isNull(), 1).when(c("want") != c("fingerprint"), c("revision") + 1).otherwise(c("revision"))
    return both.select("project", action.alias("action"), revision.cast("long").alias("revision"), F.coalesce("want", "fingerprint").alias("fingerprint"), F.coalesce("trusted", "trusted_revision").alias("trusted_revision"))


def rebuild(previous: dict[str, DataFrame], inputs: dict[str, DataFrame], plan: DataFrame) -> dict[str, DataFrame]:
    """The memory after a plan. Only projects that it creates, rebuilds or reconstructs are built; others keep their rows.

    The plan is stored, as every table of the inputs and of the memory meets it: else its two states would be built for each of them.
    """
    plan = stored(plan.select("project", "action"), "plan")
    moved = plan.where(c("action").isin("create", "rebuild", "reconstruct")).select("project")
    kept = plan.where(c("action").isin("keep", "refresh")).select("project")
    new = build({name: df.join(moved, "project", "left_semi") for name, df in inputs.items()})
    return {name: previous[name].join(kept, "project", "left_semi").unionByName(df) for name, df in new.items()}


# --- X44: drift --------------------------------------------------------------------------

#: The models of a state, their categories of drift (missing row, stale row), and which unexpected rows are only reported.
MODELS = {
    "resolvedEntities": ("missing_row", "stale_field"),
    "identityKeys": ("missing_row", "stale_identity_key"),
    "aliases": ("missing_alias", "stale_alias"),
    "redirects": ("missing_row", "stale_field"),
    "sourceEntityOwnership": ("wrong_entity_ownership", "wrong_entity_ownership"),
    "assertionOwnership": ("stale_assertion_owner", "stale_assertion_owner"),
    "relationships": ("missing_relationship", "stale_relationship_endpoint"),
    "conflicts": ("missing_conflict", "stale_conflict"),
    "conflictAssertionLinks": ("source_evidence_lineage_mismatch", "source_evidence_lineage_mismatch"),
    "sources": ("source_evidence_lineage_mismatch", "source_evidence_lineage_mismatch"),
    "evidence": ("source_evidence_lineage_mismatch", "source_evidence_lineage_mismatch"),
    "assertionSourceLinks": ("source_evidence_lineage_mismatch", "source_evidence_lineage_mismatch"),
    "assertionEvidenceLinks": ("source_evidence_lineage_mismatch", "source_evidence_lineage_mismatch"),
}
REPORTED = ("identityKeys", "aliases", "redirects", "conflicts", "conflictAssertionLinks")


def _long(models: dict[str, DataFrame]) -> DataFrame:
    """All rows of a state: project, model, id, digest, and what the rules look at (entity, accepted, kind)."""
    out = None
    for model in MODELS:
        df, text = models[model], F.lit(None).cast("string")
        rows = df.select(
            "project", F.lit(model).alias("model"), c("id").cast("string").alias("id"), row_digest(df, "project").alias("digest"),
            (c("entity") if model in ("sourceEntityOwnership", "assertionOwnership") else text).cast("string").alias("entity"),
            (c("accepted") if model == "aliases" else F.lit(False)).alias("accepted"), (c("kind") if model == "relationships" else text).alias("kind"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def drift(desired: dict[str, DataFrame], persisted: dict[str, DataFrame], heads: DataFrame, issues: DataFrame) -> DataFrame:
    """Project, category, model, id, n, repairable and action of every drift between two states.

    Each state has the 13 tables of MODELS, all with project and id: ``resolvedEntities`` (type, active), ``identityKeys`` (entity, type, value,
    strong, authoritative), ``aliases`` (accepted), ``redirects`` (id to dst), both ownerships (entity), ``relationships`` (kind, a, b,
    from_assertion, to_assertion); more columns are compared too. ``heads``: project, desired and persisted trusted revisions and fingerprints.
    ``issues``: project, category (governance_history_gap or governance_history_integrity_failure), id. Of a group of rows that drift together
    the least id stands for all n. All models are compared by one join.
    """
    both = _long(desired).join(_long(persisted).select("project", "model", "id", *(c(x).alias(f"p_{x}") for x in ("digest", "entity", "accepted", "kind"))), ["project", "model", "id"], "full_outer")
    wanted = desired["redirects"].select("project", c("id").cast("string").alias("src"), c("dst").cast("string").alias("dst"))
    ends = chains(wanted).where("not cyclic").select("project", c("src").alias("entity"), c("dst").alias("end"))
    both = both.join(wanted.select("project", c("src").alias("id"), F.lit("resolvedEntities").alias("model"), F.lit(True).alias("redirected")).distinct(), ["project", "model", "id"], "left")
    both = both.join(ends, ["project", "entity"], "left").withColumn("redirected", F.coalesce("redirected", F.lit(False)))
    missing, unexpected = c("p_digest").isNull(), c("digest").isNull()
    moved = c("entity").isNotNull() & (F.coalesce("end", "entity") == c("p_entity"))
    stale = (c("digest") != c("p_digest")) & ~moved & ~c("redirected")
    which = lambda k: F.element_at(F.create_map(*(F.lit(x) for m, v in MODELS.items() for x in (m, v[k]))), c("model"))
    held = c("model").isin(*REPORTED) | c("redirected") | ((c("model") == "relationships") & (c("p_kind") != "supports"))
    found = F.when(missing, F.struct(which(0).alias("category"), F.lit(True).alias("repairable"), F.lit("insert").alias("action")))
    found = found.when(unexpected & ~c("p_accepted"), F.struct(F.lit("unexpected_row").alias("category"), (~held).alias("repairable"), F.when(held, "report").otherwise("deactivate").alias("action")))
    found = found.when(stale, F.struct(which(1).alias("category"), F.lit(True).alias("repairable"), F.lit("update").alias("action")))
    out = both.withColumn("found", found).where("found is not null").select("project", "found.category", "model", "id", F.lit(1).cast("long").alias("n"), "found.repairable", "found.action")

    def more(df: DataFrame, category: str, model: str, repairable: bool, action: str) -> DataFrame:
        return df.select("project", F.lit(category).alias("category"), F.lit(model).alias("model"), c("id").cast("string").alias("id"), c("n").cast("long").alias("n"), F.lit(repairable).alias("repairable"), F.lit(action).alias("action"))

    kept = persisted["redirects"].select("project", c("id").cast("string").alias("src"), c("dst").cast("string").alias("dst"))
    active = persisted["resolvedEntities"].where("active").select("project", c("id").cast("string").alias("dst"))
    broken = kept.join(active, ["project", "dst"], "left_anti").select("project", c("src").alias("id"), F.lit(1).alias("n"))
    cyclic = chains(kept).where("cyclic").select("project", c("src").alias("id"), F.lit(1).alias("n"))
    owners = persisted["identityKeys"].where("strong and authoritative").groupBy("project", "type", "value", "entity").agg(F.count("*").alias("n"))
    owners = owners.groupBy("project", "type", "value").agg(F.min("entity").alias("id"), F.count("*").alias("owners"), F.sum("n").alias("n")).where("owners > 1")
    twice = persisted["relationships"].groupBy("project", "kind", "a", "b", "from_assertion", "to_assertion").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1")
    heads = heads.withColumns({"id": F.lit(""), "n": F.lit(0)})
    out = out.union(more(broken, "broken_redirect", "redirects", True, "update")).union(more(cyclic, "redirect_cycle", "redirects", False, "block"))
    out = out.union(more(owners, "conflicting_identity_key_ownership", "identityKeys", False, "block")).union(more(twice, "duplicate_relationship", "relationships", True, "deactivate"))
    out = out.union(more(heads.where("not desired_trusted <=> persisted_trusted"), "trusted_knowledge_revision_mismatch", "business_memory", True, "synchronize_trusted_knowledge_revision"))
    out = out.union(more(heads.where("not desired_fingerprint <=> persisted_fingerprint"), "revision_fingerprint_mismatch", "business_memory", True, "synchronize_fingerprint"))
    history = issues.select("project", "category", F.lit("governance").alias("model"), c("id").cast("string").alias("id"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("repairable"), F.lit("block").alias("action"))
    return out.union(history)


# --- X45: typed repairs ------------------------------------------------------------------

#: The operation that repairs a category; a model named here has its own. The rank of each operation follows.
OPERATION = {
    "missing_row": "insertResolvedEntity", "unexpected_row": "deactivateResolvedEntity", "stale_field": "updateResolvedEntity", "wrong_entity_ownership": "assignSourceEntityOwner", "broken_redirect": "repairRedirect",
    "stale_identity_key": "updateIdentityKey", "missing_alias": "insertAlias", "stale_alias": "updateAlias", "stale_assertion_owner": "assignAssertionOwner", "missing_relationship": "rewireRelationship",
    "stale_relationship_endpoint": "rewireRelationship", "duplicate_relationship": "collapseDuplicateRelationship", "missing_conflict": "insertConflict", "stale_conflict": "updateConflict",
    "source_evidence_lineage_mismatch": "repairEvidenceLink", "trusted_knowledge_revision_mismatch": "synchronizeTrustedKnowledgeRevision", "revision_fingerprint_mismatch": "synchronizeFingerprint",
}
MODEL_OPERATION = {"sources": "repairSourceLink", "conflictAssertionLinks": "replaceConflictAssertionLinks", "assertionSourceLinks": "repairSourceLink", "assertionEvidenceLinks": "repairEvidenceLink", "evidence": "repairEvidenceLink"}
RANK = {
    "insertResolvedEntity": 0, "updateResolvedEntity": 1, "assignSourceEntityOwner": 2, "assignAssertionOwner": 3, "updateIdentityKey": 5, "insertAlias": 6, "updateAlias": 7, "repairRedirect": 10,
    "rewireRelationship": 11, "collapseDuplicateRelationship": 12, "insertConflict": 13, "updateConflict": 14, "replaceConflictAssertionLinks": 15, "repairSourceLink": 16, "repairEvidenceLink": 17,
    "synchronizeTrustedKnowledgeRevision": 18, "deactivateResolvedEntity": 20, "synchronizeFingerprint": 99,
}


def repair_plan(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The typed operations in order of rank, and the projects (with a code) that are refused since a drift of theirs can't be repaired."""
    of = lambda table, key: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    refused = found.where("not repairable").groupBy("project").agg(F.count("*").alias("n")).select("project", F.lit("business_memory_unrepairable_drift").alias("code"), "n")
    operation = F.coalesce(of(MODEL_OPERATION, c("model")), of(OPERATION, c("category")))
    plan = found.join(refused.select("project"), "project", "left_anti").withColumn("operation", operation)
    return plan.select("project", of(RANK, c("operation")).alias("rank"), "operation", "category", "model", "id", "action"), refused


def outcome(found: DataFrame, heads: DataFrame) -> DataFrame:
    """What a reconciliation does to each project of ``heads`` (project, revision, expected): no_op, repaired, blocked or conflict.

    A project whose revision is not the expected one is left alone; a repair makes the next revision.
    """
    own = found.groupBy("project").agg(F.count("*").alias("n"), F.bool_and("repairable").alias("fine"))
    own = heads.join(own, "project", "left")
    result = F.when(c("revision") != c("expected"), "conflict").when(c("n").isNull(), "no_op").when(~c("fine"), "blocked").otherwise("repaired")
    return own.select("project", result.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"), (c("revision") + (result == "repaired").cast("long")).alias("revision"))


# --- X41: merges -------------------------------------------------------------------------

MERGE = "business_memory_"


def merge_refusals(commands: DataFrame, entities: DataFrame, redirects: DataFrame, revisions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Project, command, code (null if it may run) and ``replayed`` of each merge command.

    ``commands``: project, command, survivor, merged (ids), expected, auto, evidence (rules), actor, reason. ``entities``: project, id, type,
    active. ``redirects``: project, src, dst. ``revisions``: project, revision. ``ledger``: project, command, digest of commands that ran, where
    ``digest`` is ``row_digest`` of the command. A command that ran is replayed, unless it has another content now.
    """
    ends = chains(redirects).where("not cyclic").select("project", c("src").alias("id"), c("dst").alias("end"))
    own = commands.withColumn("digest", row_digest(commands, "project")).join(ledger.select("project", "command", c("digest").alias("ran")), ["project", "command"], "left").join(revisions, "project", "left")
    named = own.select("project", "command", F.explode(F.concat(F.array(F.struct(c("survivor").alias("id"), F.lit(True).alias("keeps"))), F.transform("merged", lambda m: F.struct(m.alias("id"), F.lit(False).alias("keeps"))))).alias("m")).select("project", "command", "m.*")
    named = named.join(ends, ["project", "id"], "left").withColumn("id", F.coalesce("end", "id")).join(entities.where("active"), ["project", "id"], "left")
    seen = named.groupBy("project", "command").agg(
        F.bool_or(c("keeps") & c("type").isNull()).alias("no_survivor"), F.bool_or(~c("keeps") & c("type").isNull()).alias("no_entity"), F.countDistinct("type").alias("types"),
    )
    own = own.join(seen, ["project", "command"])
    none = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    members = (F.size("merged") == 0) | (F.size(F.array_distinct("merged")) < F.size("merged")) | F.array_contains("merged", c("survivor"))
    checks = (
        (c("ran").isNotNull() & (c("ran") != c("digest")), "merge_command_content_conflict"), (c("ran").isNotNull(), None), (~c("expected").eqNullSafe(c("revision")), "stale_revision"), (members, "invalid_merge_members"),
        (c("no_survivor"), "invalid_merge_survivor"), (c("no_entity"), "invalid_merge_entity"), (c("types") > 1, "incompatible_entity_types"),
        (c("auto") & ~F.array_contains("evidence", "authoritative_exact_key"), "unqualified_auto_merge"), (~c("auto") & (none(c("actor")) | none(c("reason"))), "manual_merge_requires_actor_and_reason"),
    )
    code = F.lit(None).cast("string")
    for test, name in reversed(checks):
        code = F.when(test, F.lit(None if name is None else MERGE + name)).otherwise(code)
    return own.select("project", "command", code.alias("code"), (c("ran").isNotNull() & (c("ran") == c("digest"))).alias("replayed"))


def merges(links: DataFrame, entities: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which entities become one (project, id, survivor), and the groups that are refused (project, survivor, code).

    ``links``: project, a, b of entities to merge; ``entities``: project, id, type, active; ``keys``: project, entity, type, value of active,
    strong, authoritative identity keys. Active entities that links connect are a group, whose least id survives. A group of several types is
    refused; so is each group that shares a key with an entity outside it, as that key would have two owners. What is refused changes no other group.
    """
    live = entities.where("active").select("project", "id", "type")
    fit = links.join(shuffled(live.select("project", c("id").alias("a"))), ["project", "a"], "left_semi").join(shuffled(live.select("project", c("id").alias("b"))), ["project", "b"], "left_semi")
    own = components(fit.select("project", "a", "b"))
    mixed = own.join(shuffled(live), ["project", "id"]).groupBy("project", "root").agg(F.countDistinct("type").alias("types")).where("types > 1").select("project", "root", F.lit(MERGE + "incompatible_entity_types").alias("code"))
    owner = keys.join(shuffled(own.select("project", c("id").alias("entity"), "root")), ["project", "entity"], "left").select("project", "type", "value", F.coalesce("root", "entity").alias("owner"), c("root").isNotNull().alias("moves")).distinct()
    shared = owner.groupBy("project", "type", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    torn = owner.where("moves").join(shuffled(shared), ["project", "type", "value"]).select("project", c("owner").alias("root"), F.lit(MERGE + "conflicting_strong_identity_key").alias("code"))
    refused = mixed.union(torn).groupBy("project", "root").agg(F.max("code").alias("code"))
    done = own.join(shuffled(refused), ["project", "root"], "left_anti")
    return done.select("project", "id", c("root").alias("survivor")), refused.select("project", c("root").alias("survivor"), "code")


def merged_state(state: dict[str, DataFrame], done: DataFrame) -> dict[str, DataFrame]:
    """Entities, redirects, aliases, keys and ownership after merges (project, id, survivor).

    Redirects are flattened: old and new ones all lead to their end; those that lead into a cycle are kept apart in
    ``cycles``. Aliases and keys that become equal are one row, with the least id and whatever any of them had.
    """
    moved = done.where("id <> survivor")
    to = lambda name: moved.select("project", c("id").alias(name), "survivor")
    follow = lambda df, name: df.join(shuffled(to(name)), ["project", name], "left").withColumn(name, F.coalesce("survivor", name)).drop("survivor")
    old = state["redirects"].select("project", "src", "dst").join(shuffled(moved.select("project", c("id").alias("src"))), ["project", "src"], "left_anti")
    ends = chains(old.union(moved.select("project", "id", "survivor")))
    aliases = follow(state["aliases"], "entity").groupBy("project", "entity", "value").agg(F.min("id").alias("id"), F.bool_or("accepted").alias("accepted"), F.count("*").alias("n"))
    keys = follow(state["keys"], "entity").groupBy("project", "entity", "type", "value", "source").agg(F.min("id").alias("id"), F.bool_or("strong").alias("strong"), F.bool_or("authoritative").alias("authoritative"), F.count("*").alias("n"))
    gone = moved.select("project", "id", F.lit(True).alias("gone"))
    entities = state["entities"].join(shuffled(gone), ["project", "id"], "left").withColumn("active", c("active") & c("gone").isNull()).drop("gone")
    return {
        "entities": entities, "redirects": ends.where("not cyclic and src <> dst").drop("cyclic"), "cycles": ends.where("cyclic").select("project", "src"),
        "aliases": aliases, "keys": keys, "ownership": follow(state["ownership"], "entity"),
    }

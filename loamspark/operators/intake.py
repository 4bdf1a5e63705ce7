"""From intake facts to review entries and knowledge packs (X18, X26, X62, R6), and which PDFs to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import urls as U
from ..session import stored

#: The question of a fact by its category; {} stands for its title, else its content.
QUESTIONS = {
    "service": "Do you offer {}?",
    "pricing": "How does pricing work for {}?",
    "policy": "What is your policy regarding {}?",
    "process": "How does {} work?",
    "audience": "Who is this business best suited for?",
    "business_profile": "What does this business do?",
    "differentiator": "What makes this business different?",
}
#: Words of a PDF's address or link text that speak for and against reading it.
PDF_DURABLE = r"(?i)(?:^|[^a-z])(?:brochures?|menus?|catalog(?:ue)?s?|services?|pricing|prices?|rates?|polic(?:y|ies)|manuals?|guides?|specifications?|capabilities|products?|packages?)(?:[^a-z]|$)"
PDF_EDITORIAL = r"(?i)(?:^|[^a-z])(?:newsletters?|press[\s_-]*releases?|magazines?|blogs?|news|articles?|posts?|archives?|annual[\s_-]*(?:content|archive))(?:[^a-z]|$)"
#: The states that count as reviewed, and the sections of a pack.
REVIEWED = ("approved", "corrected")
SECTIONS = {"behavior_rule": "behavior_rules", "prohibited_claim": "prohibited_claims"}


def comparable(text: Column) -> Column:
    """Lower-cased text without quotes, other signs as spaces."""
    bare = F.regexp_replace(F.lower(T.clean(text)), "[“”\"'`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9$%./:\-\s]", " "), r"\s+", " "))


def question(category: Column, title: Column, content: Column) -> Column:
    """The question that a fact answers; null for categories without one."""
    subject = T.clean(F.coalesce(F.nullif(title, F.lit("")), content))
    out = F.lit(None).cast("string")
    for name, form in QUESTIONS.items():
        before, _, after = form.partition("{}")
        out = F.when(category == name, F.concat(F.lit(before), subject, F.lit(after)) if after else F.lit(form)).otherwise(out)
    return out


def faq_candidates(facts: DataFrame) -> DataFrame:
    """Facts (session, ordinal, fact_id, category, title, content, score) to FAQs, the first of each question of a session."""
    own = facts.withColumn("question", question(F.col("category"), F.col("title"), F.col("content"))).where("question is not null")
    own = own.withColumn("faq_id", T.stable_id("generated_faq", F.concat_ws(":", "question", "fact_id"), padded=False))
    level = F.when(F.col("score") >= 0.82, "high").when(F.col("score") >= 0.58, "medium").otherwise("low")
    row = F.struct("ordinal", "faq_id", "fact_id", "question", F.col("content").alias("answer"), level.alias("confidence"))
    # The least row wins, so Spark keeps one of a question before it shuffles.
    first = own.groupBy("session", comparable(F.col("question")).alias("_key")).agg(F.min(row).alias("first")).where("_key <> ''")
    return first.select("session", "first.faq_id", "first.fact_id", "first.question", "first.answer", "first.confidence")


def reconcile(entries: DataFrame, facts: DataFrame, default: str = "proposed") -> DataFrame:
    """Review entries (project, entry_id, category, status) and those of facts (project, scoped_id, plain_id, category) that have none yet.

    Entries stay as they are, archived ones too. A fact has an entry if one has its scoped or its plain id.
    """
    known = entries.select("project", "entry_id")
    fresh = facts.join(known.withColumnRenamed("entry_id", "scoped_id"), ["project", "scoped_id"], "left_anti")
    fresh = fresh.join(known.withColumnRenamed("entry_id", "plain_id"), ["project", "plain_id"], "left_anti")
    added = fresh.select("project", F.col("scoped_id").alias("entry_id"), "category", F.lit(default).alias("status"), F.lit(True).alias("added"))
    return entries.select("project", "entry_id", "category", "status", F.lit(False).alias("added")).union(added)


def review_counts(entries: DataFrame, faqs: DataFrame) -> DataFrame:
    """Counts of each project by state over its FAQs (project, entry_id, status) and the entries that support none of them."""
    alone = entries.join(faqs.select("project", "entry_id"), ["project", "entry_id"], "left_anti").select("project", "status")
    both = alone.union(faqs.select("project", "faq_id", "status").distinct().select("project", "status"))
    n = lambda *states: F.count_if(F.col("status").isin(*states))
    return both.groupBy("project").agg(F.count("*").alias("total"), n(*REVIEWED).alias("approved"), n("proposed").alias("proposed"), n("archived").alias("archived"))


def knowledge_pack(entries: DataFrame, faqs: DataFrame) -> DataFrame:
    """The reviewed entries (session, entry_id, category, title, content, status) and FAQs (session, faq_id, question, answer, status) of each session by section.

    ``place`` is their order in a section. It is counted in ranges of names, as many as the shuffle
    has partitions, so a session of any size is sorted in parts. The ranges are written once: both
    the sizes and the rows must see the same.
    """
    section = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SECTIONS.items() for x in kv)), F.col("category")), F.lit("facts"))
    facts = entries.where(F.col("status").isin(*REVIEWED)).select("session", section.alias("section"), F.concat(F.lit("knowledge_"), "entry_id").alias("item_id"), "category", T.clean(F.col("title")).alias("name"), T.clean(F.col("content")).alias("content"))
    asked = faqs.where(F.col("status").isin(*REVIEWED)).select("session", F.lit("faq").alias("section"), F.concat(F.lit("knowledge_"), "faq_id").alias("item_id"), F.lit("").alias("category"), T.clean(F.col("question")).alias("name"), T.clean(F.col("answer")).alias("content"))
    rows = facts.union(asked).repartitionByRange("session", "section", "category", "name", "item_id").withColumn("_part", F.spark_partition_id())
    rows = stored(rows, "pack")
    order = W.partitionBy("session", "section", "_part").orderBy("category", "name", "item_id")
    rows = rows.withColumn("_n", F.row_number().over(order))
    sizes = rows.groupBy("session", "section", "_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.partitionBy("session", "section").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return rows.join(before, ["session", "section", "_part"]).withColumn("place", F.col("_n") + F.col("_before")).drop("_n", "_before", "_part")


def eligible_pdf(url: Column, said: Column) -> Column:
    """An http address that looks like a PDF, of lasting use and not editorial, by path, query values and link text."""
    said = F.coalesce(said, F.lit(""))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    path = plain(U.path(url))
    values = F.transform(F.filter(F.split(F.coalesce(U.query(url), F.lit("")), "&"), lambda p: p.contains("=")), lambda p: plain(F.regexp_replace(p, "^[^=]*=", "")))
    looks = path.rlike(r"(?i)\.pdf$") | F.exists(values, lambda v: v.rlike(r"(?i)\.pdf$")) | (said.rlike(r"(?i)\bpdf\b") & said.rlike(PDF_DURABLE))
    evidence = F.concat_ws(" ", F.regexp_replace(path, "[/.]+", " "), F.array_join(values, " "), said)
    return F.coalesce(url.rlike("(?i)^https?://") & looks & evidence.rlike(PDF_DURABLE) & ~evidence.rlike(PDF_EDITORIAL), F.lit(False))

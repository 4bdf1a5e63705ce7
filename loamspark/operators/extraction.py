"""Validation of what a model extracted from intake blocks (X16): all issues of every item, with code and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .memory import REVIEW_TYPE

c = F.col
KEY = ["project", "extraction"]

#: Issues that make an extraction invalid; lengths; levels of scores.
FATAL = ("invalid_root", "invalid_fact", "invalid_category", "missing_source_block", "missing_source_excerpt", "source_excerpt_not_found")
LEAST_CONTENT, TITLE_CHARS = 4, 100
HIGH, MEDIUM = 0.82, 0.58


def _comparable(text: Column) -> Column:
    return T.comparable_text(F.regexp_replace(F.coalesce(text, F.lit("")), "[“”\"'`]", ""))


def _elements(root: Column, *names: str) -> Column:
    """The elements of a list of the root, as JSON texts; the first name that is there counts."""
    found = F.coalesce(*(F.get_json_object(root, f"$.{n}") for n in names))
    return F.coalesce(F.from_json(found, "array<string>"), F.array().cast("array<string>"))


def _field(item: Column, *names: str) -> Column:
    return T.clean(F.coalesce(*(F.get_json_object(item, f"$.{n}") for n in names), F.lit("")))


def _texts(item: Column, most: int, *names: str) -> Column:
    """A list of texts, each once by its comparable form, ``most`` at most."""
    values = F.filter(F.transform(_elements(item, *names), T.clean), lambda x: _comparable(x) != "")
    first = F.filter(values, lambda x, i: F.size(F.filter(F.slice(F.transform(values, _comparable), 1, F.greatest(i, F.lit(1))), lambda y: (y == _comparable(x)) & (i > 0))) == 0)
    return F.slice(first, 1, most)


def grounded(content: Column, excerpt: Column) -> Column:
    """Whether a text holds an excerpt, or at least four fifths of its four or more longer words."""
    source, said = _comparable(content), _comparable(excerpt)
    words = F.filter(F.split(said, " "), lambda w: F.length(w) > 2)
    share = F.size(F.filter(words, lambda w: F.contains(source, w))) / F.size(words)
    return (source != "") & (said != "") & (F.contains(source, said) | ((F.size(words) >= 4) & (share >= 0.8)))


def validate(outputs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted items, issues, and the verdict of each extraction.

    ``outputs``: project, extraction, output (JSON of a model, with names in snake or camel case); ``blocks``: project, id, content.
    Items: project, extraction, kind (fact, faq, conflict, missing), nth, key, confidence (of facts and FAQs). An item shows the first
    issue it has; of accepted items with one comparable key the first stays, and repeated facts are an issue of their list.
    """
    shape = F.from_json("output", "map<string,string>")
    own = outputs.select(*KEY, "output").withColumn("empty", F.coalesce(F.size(shape) < 1, F.lit(True)) | ~F.coalesce(F.trim("output"), F.lit("")).startswith("{"))
    bad_root = own.where("empty").select(*KEY, F.lit("invalid_root").alias("code"), F.lit("$").alias("path"))
    own = own.where("not empty")
    block = blocks.select("project", c("id").alias("block"), c("content").alias("block_content"))
    each = lambda *names: own.select(*KEY, F.posexplode(_elements(c("output"), *names)).alias("nth", "item"))
    path = lambda name, rest="": F.concat(F.lit(f"{name}["), c("nth").cast("string"), F.lit(f"]{rest}"))
    number = F.try_to_number(_field(c("item"), "confidenceScore", "confidence_score"), F.lit("9.999999")).cast("double")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))
    level = F.get_json_object("item", "$.confidence")
    confidence = F.when(level.isin("high", "medium", "low"), level).when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")

    facts = each("facts").withColumns({"category": F.get_json_object("item", "$.category"), "content": _field(c("item"), "content"), "block": _field(c("item"), "sourceBlockId", "source_block_id"), "excerpt": _field(c("item"), "sourceExcerpt", "source_excerpt")})
    facts = facts.join(block, ["project", "block"], "left")
    checks = (
        (~F.coalesce(c("category").isin(*REVIEW_TYPE), F.lit(False)), "invalid_category", ".category"), (F.length("content") < LEAST_CONTENT, "invalid_fact", ".content"), (c("block_content").isNull(), "missing_source_block", ".sourceBlockId"),
        (c("excerpt") == "", "missing_source_excerpt", ".sourceExcerpt"), (~grounded(c("block_content"), c("excerpt")), "source_excerpt_not_found", ".sourceExcerpt"),
    )
    issue = F.lit(None).cast("struct<code:string,path:string>")
    for test, code, rest in reversed(checks):
        issue = F.when(test, F.struct(F.lit(code).alias("code"), path("facts", rest).alias("path"))).otherwise(issue)
    named = F.coalesce(F.nullif(_field(c("item"), "temporaryId", "temporary_id"), F.lit("")), T.stable_id("fact", F.concat_ws(":", c("project").cast("string"), "category", "content", "block"), padded=False))
    facts = facts.select(*KEY, F.lit("fact").alias("kind"), "nth", F.concat_ws(":", "category", "content").alias("key"), confidence.alias("confidence"), issue.alias("issue"), named.alias("id"))

    def sourced(rows: DataFrame, most: int) -> DataFrame:
        """With ``sources``, how many of the item's blocks are the project's."""
        ids = rows.select(*KEY, "nth", F.explode(_texts(c("item"), most, "sourceBlockIds", "source_block_ids")).alias("block")).join(block.select("project", "block"), ["project", "block"], "left_semi")
        return rows.join(ids.groupBy(*KEY, "nth").agg(F.count("*").alias("sources")), [*KEY, "nth"], "left").withColumn("sources", F.coalesce("sources", F.lit(0)))

    def items(rows: DataFrame, kind: str, name: str, key: Column, tests: list[tuple[Column, str]], level: Column) -> DataFrame:
        issue = F.lit(None).cast("struct<code:string,path:string>")
        for test, code in reversed(tests):
            issue = F.when(test, F.struct(F.lit(code).alias("code"), path(name).alias("path"))).otherwise(issue)
        return rows.select(*KEY, F.lit(kind).alias("kind"), "nth", key.alias("key"), level.alias("confidence"), issue.alias("issue"), F.lit(None).cast("string").alias("id"))

    item, none = c("item"), F.lit(None).cast("string")
    question, answer = _field(item, "question"), _field(item, "answer")
    faqs = sourced(each("faqCandidates", "faq_candidates"), 8)
    lacks = (c("sources") == 0) | (F.size(_texts(item, 8, "sourceExcerpts", "source_excerpts")) == 0)
    faqs = items(faqs, "faq", "faqCandidates", question, [((question == "") | (answer == ""), "invalid_faq_candidate"), (lacks, "missing_source_excerpt")], confidence)
    topic, asks = _field(item, "topic"), _field(item, "suggestedQuestion", "suggested_question")
    one, two = _field(item, "firstStatement", "first_statement"), _field(item, "secondStatement", "second_statement")
    conflicts = sourced(each("conflicts"), 6)
    partial = (topic == "") | (one == "") | (two == "") | (asks == "") | (c("sources") == 0) | (F.size(_texts(item, 6, "sourceExcerpts", "source_excerpts")) < 2)
    conflicts = items(conflicts, "conflict", "conflicts", F.concat_ws(":", topic, one, two), [(partial, "invalid_conflict")], none)
    missing = items(each("missingInformation", "missing_information"), "missing", "missingInformation", topic, [((topic == "") | (_field(item, "reason") == "") | (asks == ""), "invalid_missing_item")], none)

    every = facts.union(faqs).union(conflicts).union(missing)
    fine = every.where("issue is null").withColumn("norm", _comparable(c("key")))
    first = F.row_number().over(W.partitionBy(*KEY, "kind", "norm").orderBy("nth"))
    fine = fine.withColumn("copy", (first > 1) | (c("norm") == ""))
    repeated = fine.where("copy and kind = 'fact'").select(*KEY, F.lit("duplicate_item").alias("code"), F.lit("facts").alias("path")).distinct()
    issues = bad_root.union(every.where("issue is not null").select(*KEY, "issue.code", "issue.path")).union(repeated)
    fatal = issues.where(c("code").isin(*FATAL)).select(*KEY).distinct().withColumn("valid", F.lit(False))
    verdict = outputs.select(*KEY).join(fatal, KEY, "left").select(*KEY, F.coalesce("valid", F.lit(True)).alias("valid"))
    return fine.where("not copy").select(*KEY, "kind", "nth", "key", "confidence", "id"), issues, verdict

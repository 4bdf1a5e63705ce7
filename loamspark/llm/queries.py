"""Queries of the corpus operators: op<N>_<name>(spark, sf_dir) and their SQL, where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, html_extraction, importance_resampling, language_id, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, token_alignment, toxicity, url_filter
from .common import read_table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(spark, read_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(spark, read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(spark, read_table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.as_text(F.col("spans")).alias("spans"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, read_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(spark, read_table(spark, sf_dir, "conversations"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_texts(spark, read_table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in url_filter.LISTED], "key string")
    return url_filter.judge(spark, read_table(spark, sf_dir, "pages"), listed)


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(spark, read_table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resampling.resample(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict:
    every = (
        op1_minhash_dedup, op2_decontaminate, op3_mix_sources, op4_chat_format, op5_secrets,
        op6_quality_classifier, op7_language_id, op8_quality_rules, op9_html_extract, op10_url_filter,
        op11_align_tokenizers, op12_toxicity, op13_resample,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    rest = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END"
    fits = lambda rule: (lambda d, p: f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}')")(*rule.split("/", 1))
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r), r))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in url_filter.RULES.items())
    listed = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in url_filter.LISTED)
    return {
        "op10_url_filter": f"""
            WITH cut AS (SELECT page_id, {rest} AS rest FROM pages),
            parts AS (
                SELECT page_id,
                       coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
                       coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
                FROM cut),
            ruled AS (SELECT *, {rule} AS rule FROM parts)
            SELECT page_id, host, path, rule, {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    }

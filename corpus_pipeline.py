"""A training-corpus pipeline: documents in, mixed training documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the documents of the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamspark.llm import decontamination, language_id, mixing, near_dedup, secret_scan
from loamspark.llm.common import Scratch, read_table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected, and those without a letter (null, empty, digits only)."""
    return language_id.keep_known(spark, docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates; documents without a word are copies of each other only with equal id and text."""
    return near_dedup.keep_one(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; a null text holds none."""
    return decontamination.keep_clean(spark, docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark; every document stays, null texts as they are."""
    return secret_scan.redact(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order of the mixture, with slot and place; every row stays, whatever its id and source."""
    return mixing.mixed(spark, docs)


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_class),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("source mixing", mixture),
]

#: Language models, sampled similarity, edit matching and deadline scheduling have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs

"""Readers of untrusted rows: line-delimited JSON, JSON columns and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed values.
LINE_BYTES = 8 * 1024 * 1024
SITEMAP = r"(?is)<(?:\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc>"


def table(spark: SparkSession, path: str, format: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table in any format that Spark reads, with a schema given wherever the format has none."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def json_rows(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``rows`` with the parsed struct ``row`` and ``invalid`` (no JSON object, a wrong type, or too long)."""
    text = F.col(column)
    parsed = F.from_json(text, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    out = rows.withColumn("row", parsed)
    bad = (F.octet_length(text) > LINE_BYTES) | ~F.coalesce(F.trim(text).startswith("{"), F.lit(False)) | F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    return out.withColumn("invalid", F.coalesce(bad, F.lit(True)))


def ndjson(spark: SparkSession, path: str, schema: str, mode: str = "raise") -> DataFrame:
    """Events, one JSON object a line. Invalid lines raise an error when read, or are dropped (``mode="drop"``)."""
    lines = json_rows(spark.read.text(path).where("trim(value) <> ''"), "value", schema)
    if mode == "drop":
        lines = lines.where("not invalid")
    else:
        checked = F.when(~F.col("invalid"), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("invalid event: "), F.substring("value", 1, 200))))
        lines = lines.withColumn("row", checked)
    return lines.select("row.*").drop("_corrupt")


def recordset(rows: DataFrame, column: str, schema: str, keep: list[str], valid: Column | None = None) -> DataFrame:
    """The elements of a JSON array column as rows; those that fail ``valid`` are dropped."""
    each = rows.select(*keep, F.inline(F.from_json(column, f"array<struct<{schema}>>")))
    return each.where(valid) if valid is not None else each


def sitemap(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """S2, X3e: url and kind (``index`` or ``page``) of every location in sitemap documents."""
    kind = F.when(F.col(column).rlike(r"(?i)<(?:\w+:)?sitemapindex\b"), "index").otherwise("page")
    found = F.regexp_extract_all(column, F.lit(SITEMAP), F.lit(1))
    return rows.select(*keep, kind.alias("kind"), F.explode(found).alias("url")).withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&"))).where("url <> ''")

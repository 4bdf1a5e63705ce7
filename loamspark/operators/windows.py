"""Ordered operators: numbering, latest rows, top-k and pages of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "seq") -> DataFrame:
    """Dense numbers from 1 within each key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key; Spark cuts groups before the shuffle."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def latest(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """W3, W10, T12 as one aggregate: the row with the greatest ``order``, partial on the map side."""
    top = F.max_by(F.struct(*keep), F.struct(*order)).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *(F.col(f"_top.{c}").alias(c) for c in keep))


def page(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """Keyset page of rows; the limit is the operator's result size."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row before, as previous_<column>."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def running_last(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def unresolved(events: DataFrame, keys: list[str], opened: Column, resolved: Column) -> DataFrame:
    """Opening events without a later resolving event of the same key.

    One aggregate finds the latest resolution of each key, so no event meets another one by one.
    """
    last = events.where(resolved).groupBy(*keys).agg(F.max(F.struct("ts", "event_id")).alias("_last"))
    joined = events.where(opened).join(last, keys, "left")
    return joined.where(F.col("_last").isNull() | (F.struct("ts", "event_id") >= F.col("_last"))).drop("_last")

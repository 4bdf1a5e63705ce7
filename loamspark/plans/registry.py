"""Where queries and their SQL are registered, and SQL twins of the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name, each read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table dealt evenly to all cores: for small rows of which much is made, as one file of them would be one task."""
        return getattr(self, name).repartition(4 * self.spark.sparkContext.defaultParallelism)


def query(sql: str | None = None, name: str | None = None):
    """Register f(tables) -> DataFrame under its name, with its SQL."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        own = name or f.__name__
        QUERIES[own] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[own] = sql
        return f

    return put


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({x}, ''), chr(0), ''), {lit(T.SPACE + '+')}, ' ', 'g'))"


def key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({clean(x)}), '[’'']', '''', 'g'), {lit(T.NOT_KEY)}, ' ', 'g'))"


def slug(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace({key(x)}, {lit(T.ARTICLES)}, ' ', 'g')), ' +', '_', 'g')"


def merge_value(x: str) -> str:
    return f"lower({clean(x)})"


def tokens(x: str, least: int = 1) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= {least}))"


def fnv(x: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


def stable_id(prefix: str, x: str) -> str:
    return f"'{prefix}_' || lpad(lower(to_hex({fnv(x)})), 8, '0')"


def is_match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit('(?i)' + pattern)})"

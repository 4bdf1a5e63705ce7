"""Sinks that keep a table's rules: insert once, merge, delete, compare and set, NDJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_once(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """K1, K8: incoming rows with ``outcome``: inserted, present (equal in all columns) or collision."""
    rest = [c for c in incoming.columns if c not in keys]
    there = existing.select(*keys, F.struct(*rest).alias("_there"), F.lit(True).alias("_known"))
    own = F.struct(*(F.col(c) for c in rest))
    outcome = F.when(F.col("_known").isNull(), "inserted").when(own.eqNullSafe(F.col("_there")), "present").otherwise("collision")
    return incoming.join(there, keys, "left").withColumn("outcome", outcome).drop("_there", "_known")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], allowed: Column | None = None) -> DataFrame:
    """The table after a merge; ``allowed`` (over old_<column> and new_<column>) guards updates."""
    rest = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, *(F.col(c).alias(f"old_{c}") for c in rest), F.lit(True).alias("_old"))
    new = incoming.select(*keys, *(F.col(c).alias(f"new_{c}") for c in rest), F.lit(True).alias("_new"))
    take = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True)))
    return old.join(new, keys, "full_outer").select(*keys, *(F.when(take, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in rest))


def keep_submitted(existing: DataFrame, submitted: DataFrame, keys: list[str]) -> DataFrame:
    """K3: the table without the rows whose key was not submitted."""
    return existing.join(submitted.select(*keys).distinct(), keys, "left_semi")


def compare_and_set(existing: DataFrame, updates: DataFrame, key: str, revision: str) -> DataFrame:
    """Each update with ``outcome``: updated, conflict (with the current revision) or missing."""
    now = existing.select(key, F.col(revision).alias("current"))
    outcome = F.when(F.col("current").isNull(), "missing").when(F.col("current") == F.col(revision), "updated").otherwise("conflict")
    return updates.join(now, key, "left").withColumn("outcome", outcome)


def write_ndjson(df: DataFrame, path: str) -> None:
    """K5: one JSON object a line."""
    df.write.mode("append").json(path)

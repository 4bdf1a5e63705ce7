"""Session, shared-folder and small-table helpers used by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Where the session names none a temporary folder is set, but only if all runs on one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loamspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one operator run, in the shared folder.

    ``keep`` writes a table and returns it reread, which cuts the lineage so that a lost
    executor never recomputes earlier work. ``close`` deletes what was written, except the
    tables named in ``but``; what is left then is deleted when the session's driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[tuple[str, str]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{name}"
        df.write.parquet(path)
        if not self.paths:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        self.paths.append((name, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name, text in self.paths:
            if name in names:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self, *but: str) -> None:
        self.drop(*{name for name, _ in self.paths} - {*but})


def attach(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined to ``groups``, which has a row for each key with the number of rows that have it.

    Keys that hold more than a ten-thousandth of what ``groups`` counts, at most 10,000, are
    broadcast, so their rows stay where they are; the others meet by a shuffle in which no key
    is large. Rows without a group are dropped.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = groups.where(F.col(count) > total / 10_000)
    cold = groups.where(F.col(count) <= total / 10_000)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def pieces(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``most`` characters; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def slices(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list, list[str]]]:
    """The ids and texts (null: empty) of a batch, in runs of about ``most`` characters; a longer text stands alone."""
    ids, texts = batch.columns
    total = np.concatenate(([0], np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        yield ids[first:last].to_pylist(), [t or "" for t in texts[first:last].to_pylist()]
        first = last


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 3; rows of fold 1 are held out."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(-1)).cast("string").cast("binary")) % 3

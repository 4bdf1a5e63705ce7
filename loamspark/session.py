"""Session settings, and the library's code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What a session of this library sets; a cluster's own settings for sizes stay as they are.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def create(master: str = "local[8]", partitions: int = 8, **more: str) -> SparkSession:
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"} | more
    spark = SparkSession.builder.master(master).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession, root: str) -> None:
    """Let Python workers import the library: it is shipped once for each session, unless all runs on this machine and its path holds it."""
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    here = spark.sparkContext.master.startswith("local") and any(p and os.path.isdir(os.path.join(p, "loamspark")) for p in seen)
    if here or getattr(spark.sparkContext, "_loamspark", False):
        return
    path = Path(tempfile.mkdtemp()) / "loamspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(Path(root, "loamspark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._loamspark = True


def shared(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or a temporary one where all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loamspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and reread: for what several branches of a plan read.

    The table is deleted when the session's driver ends.
    """
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(table)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a table in the shared folder.

    A checkpoint would keep what the optimiser knows of the columns, which doubles with each round of a loop.
    """
    return stored(df, "cut")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: files of numbers are far smaller than their rows, so that Spark would broadcast them, through the driver."""
    return df.hint("merge")

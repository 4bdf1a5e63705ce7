"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import events as O
from ..operators import threads


def read(spark: SparkSession, folder: str, schema: str, format: str = "parquet", files: int = 100) -> DataFrame:
    """A stream of the files of a folder, ``files`` at most for each trigger."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files).load(folder)


def progress(events: DataFrame, key: str, rank: Column, done: Column) -> DataFrame:
    """Z1 over a stream, for update mode: the batch operator's aggregate."""
    return O.progress(events, key, rank, done)


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key; state is kept as long as the watermark asks."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def counts(events: DataFrame, key: str, ts: str = "ts", span: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a key in sliding spans of event time."""
    windows = F.window(ts, span, slide)
    out = events.withWatermark(ts, late).groupBy(key, windows).agg(F.count("*").alias("n"))
    return out.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def changes(events: DataFrame, key: str, signature: str, ts: str = "ts") -> DataFrame:
    """A row for each change of a key's signature; the state of a key is its last signature and time.

    Within a trigger events are taken by time; one that is older than what its key has seen is late
    and changes nothing.
    """

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, -1)
        rows = []
        for when, sign in sorted((t, s) for b in batches for t, s in zip(b["_at"], b["_sign"], strict=True)):
            if when >= at and sign != last:
                rows.append((str(of[0]), when, sign, last))
            if when >= at:
                last, at = sign, when
        state.update((last, at))
        yield pd.DataFrame(rows, columns=["key", "at", "signature", "previous"])

    own = events.select(F.col(key), O.micros(ts).alias("_at"), F.col(signature).cast("string").alias("_sign"))
    kind = "key string, at long, signature string, previous string"
    return own.groupBy(key).applyInPandasWithState(step, kind, "last string, at long", "append", GroupStateTimeout.NoTimeout)


def thread_memory(turns: DataFrame) -> DataFrame:
    """The memory of each thread after each turn; a thread's state is its memory and its last turn.

    Within a trigger turns are taken in order; one that is not after the last one seen is late and changes nothing.
    """

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, last = state.get if state.exists else (None, None)
        memory = threads._read(text) if text else threads.initial()
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        rows = rows[rows["turn"] > last] if last is not None else rows
        if len(rows):
            memory, out = threads.replayed(memory, rows)
            state.update((threads._written(memory), int(rows["turn"].iloc[-1])))
            yield pd.DataFrame([(of[0], *r) for r in out], columns=["thread", *threads.COLUMNS])

    kind = dict(turns.dtypes)["thread"]
    own = turns.select("thread", "turn", *threads.TURN)
    return own.groupBy("thread").applyInPandasWithState(step, f"thread {kind}, {threads.OUT}", "memory string, last long", "append", GroupStateTimeout.NoTimeout)

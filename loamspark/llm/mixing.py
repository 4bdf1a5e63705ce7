"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are cut into blocks, which are scheduled by halves. A slot takes one half
block. With weight w, half block j (from 0) is released at slot floor(j / w) and due by
ceil((j + 1) / w); in each slot, of the released ones, that with the earliest deadline goes out.

So that no task has to follow the whole mixture, time is cut into frames. At the border t of a
frame each source has had floor(w t) or ceil(w t) half blocks, which the running sums of the exact
weights, rounded up, decide without looking at any other frame. Inside a frame the releases and
deadlines follow from these whole numbers, so every frame ends where the next one begins and
frames are scheduled in parallel. A source is less than one half block from its target at the
borders, and less than another one from the line between them: less than one block anywhere,
however long the mixture. Weights are exact fractions and never rounded.

A phase ends when the first source runs dry, which is known from the supplies and weights; the
others go on with their weights in proportion. No document is dropped or repeated. The driver
holds the sources' names, supplies and phases, at most one phase for each source; a corpus with
more than some thousand sources should group them first.

Documents are numbered within their source by a hash of their id, in buckets whose number grows
with the input; buckets are summed in groups, so that no task has to order a whole source.

Defined results: a null source is the source with the empty name. Repeated rows and rows without
id are numbered one after another; which of them comes first follows the layout of the input. A
null text is a document like any other. The last block of a source may be short. Sources without
a target weight get none in the first phases and follow when all others have ended; without
targets the weight of a source is the square root of its size. An empty table gives an empty
result. Extra columns are ignored by ``schedule`` and kept by ``mixed``, whose own columns
``slot`` and ``place`` replace those of the input.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from fractions import Fraction
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch


@dataclass(frozen=True)
class Params:
    block: int = 8  #: documents of a block, an even number
    frame: int = 1 << 16  #: slots of a frame, at least
    bucket: int = 1024  #: documents that one window orders, about
    weights: Mapping[str, float] = field(default_factory=dict)


def integers(weights: Mapping[str, float]) -> dict[str, int]:
    """The weights in exact proportion as integers."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    part = math.gcd(*whole.values())
    return {s: n // part for s, n in whole.items()}


def turns(weights: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot, without end: earliest deadline first among the released."""
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights) if weights[s]]  # release, source, number
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []  # deadline, next release (a tie-break), source, number
    for now in itertools.count():
        while waiting and waiting[0][0] <= now:
            _, s, j = heapq.heappop(waiting)
            end, w = (j + 1) * total, weights[s]
            heapq.heappush(ready, (-(-end // w), end // w, s, j))
        _, released, s, j = heapq.heappop(ready)
        yield s
        heapq.heappush(waiting, (released, s, j + 1))


class Phase(NamedTuple):
    start: int  #: first slot
    slots: int
    frames: int
    sources: tuple[str, ...]  #: the first to run dry first
    sums: tuple[int, ...]  #: running sums of their weights
    done: tuple[int, ...]  #: what each has had before

    def border(self, k: int) -> int:
        return self.slots if k == self.frames else k * (self.slots // self.frames)

    def counts(self, k: int) -> list[int]:
        """What each source has had in this phase by the border k: its exact share, rounded up or down."""
        t, total = self.border(k), self.sums[-1]
        upto = [0, *(-(-t * x // total) for x in self.sums)]
        return [b - a for a, b in itertools.pairwise(upto)]


def phases(supply: Mapping[str, int], p: Params) -> list[Phase]:
    """The phases of a mixture of so many half blocks of each source."""
    size = {s: float(n) for s, n in supply.items()}
    target = {s: float(p.weights.get(s, 0)) for s in supply} if p.weights else {s: n**0.5 for s, n in size.items()}
    out, start, done = [], 0, dict.fromkeys(supply, 0)
    for given in ({s: w for s, w in target.items() if w > 0}, {s: size[s] for s in supply if target[s] <= 0}):
        left = integers(given) if given else {}
        while left:
            names = sorted(left, key=lambda s: (Fraction(supply[s] - done[s], left[s]), s))
            sums = tuple(itertools.accumulate(left[s] for s in names))
            slots = (supply[names[0]] - done[names[0]]) * sums[-1] // left[names[0]]
            # In a whole frame every source has a turn, so counts never fall from border to border.
            least = max(p.frame, -(-sums[-1] // min(left.values())))
            own = Phase(start, slots, max(1, slots // least), tuple(names), sums, tuple(done[s] for s in names))
            out.append(own)
            start += slots
            for s, n in zip(names, own.counts(own.frames), strict=True):
                done[s] += n
                if done[s] == supply[s]:
                    del left[s]
    return out


def frame(own: Phase, k: int) -> Iterator[tuple[str, int, int]]:
    """Source, half block and slot of each slot of a frame."""
    before, after = own.counts(k), own.counts(k + 1)
    at = {s: d + n for s, d, n in zip(own.sources, own.done, before, strict=True)}
    first, end = own.border(k), own.border(k + 1)
    for slot, s in enumerate(itertools.islice(turns({s: b - a for s, a, b in zip(own.sources, before, after, strict=True)}), end - first), own.start + first):
        yield s, at[s], slot
        at[s] += 1


def numbered(docs: DataFrame, p: Params) -> tuple[DataFrame, dict[str, int]]:
    """uid, doc_id, source and number within the source of rows with a uid; and the number of documents of each source."""
    own = docs.select("uid", "doc_id", F.coalesce("source", F.lit("")).alias("source"))
    n = max(1, own.count() // p.bucket)
    group = max(1, math.isqrt(n))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(n)))
    counts = own.groupBy("source", "bucket").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("bucket") / group))
    groups = counts.groupBy("source", "group").agg(F.sum("n").alias("n"))
    total = {r["source"]: r["n"] for r in groups.groupBy("source").agg(F.sum("n").alias("n")).collect()}

    def before(by: list[str], order: str):
        return F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    upto = groups.select("source", "group", before(["source"], "group").alias("upto"))
    counts = counts.withColumn("before", before(["source", "group"], "bucket")).join(upto, ["source", "group"])
    rank = F.row_number().over(W.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "uid")) - 1
    out = own.withColumn("rank", rank).join(counts.select("source", "bucket", (F.col("before") + F.col("upto")).alias("before")), ["source", "bucket"])
    return out.select("uid", "doc_id", "source", (F.col("rank") + F.col("before")).alias("number")), total


def planned(spark: SparkSession, docs: DataFrame, p: Params) -> DataFrame:
    """uid, doc_id, source, block (within the source), slot (in the mixture), place (within the half block) of rows with a uid."""
    half = p.block // 2
    rows, sizes = numbered(docs, p)
    found = phases({s: -(-n // half) for s, n in sizes.items()}, p)
    shared = spark.sparkContext.broadcast(found)  # names and numbers of the sources, phase by phase
    first = [0, *itertools.accumulate(x.frames for x in found)]
    turn = spark.createDataFrame([(i, x.frames) for i, x in enumerate(found)], "phase int, frames long")
    turn = turn.select("phase", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame"))
    turn = turn.repartition(max(1, min(first[-1], spark.sparkContext.defaultParallelism * 4)), "phase", "frame")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for i, k in zip(x["phase"], x["frame"], strict=True):
                for part in itertools.batched(frame(shared.value[i], int(k)), 50_000):
                    yield pd.DataFrame(part, columns=["source", "half", "slot"])

    slots = turn.mapInPandas(run, "source string, half long, slot long")
    halves = rows.withColumn("half", F.floor(F.col("number") / half)).join(slots, ["source", "half"])
    return halves.select("uid", "doc_id", "source", F.floor(F.col("number") / p.block).alias("block"), "slot", (F.col("number") % half).alias("place"))


def schedule(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, source, block, slot and place of every row."""
    rows = docs.select("doc_id", "source", F.monotonically_increasing_id().alias("uid"))
    rows = Scratch(spark, "mixing").keep(rows, "rows")  # written, so that a row's uid never changes
    return planned(spark, rows, params).drop("uid")


def mixed(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents in the order of the mixture, with their columns, slot and place.

    The result is ranged and sorted by slot, so files read in order give the mixture. Texts are
    written once with their uid and shuffled twice, to meet their slots and to be put in order.
    """
    scratch = Scratch(spark, "mixing")
    rows = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("uid"))
    rows = scratch.keep(rows, "rows")
    plan = planned(spark, rows, params).select("uid", "slot", "place")
    both = rows.select("uid", "row").join(plan, "uid")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("slot", "place")]
    return both.select(*own, "slot", "place").repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")

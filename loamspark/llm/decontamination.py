"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur in a document with up to k edits, k being ``rate`` of m but
leaving pieces of at least ``piece`` characters. The item is cut into k + 1 pieces; an occurrence
with at most k edits leaves one piece whole, so exact hits of the pieces (one Aho-Corasick pass
over the text) find every candidate. Each is verified by Myers' bit-parallel edit distance over
the stretch of text that could hold the item.

Items and texts are compared lower-cased, with runs of white space as one space. Items go to the
tasks in blocks of at most about ``block`` characters, chosen by a hash of the item; a larger
benchmark takes more passes over the documents, never a larger broadcast.

Defined results: null or blank items and texts match nothing. An item shorter than two pieces
must occur exactly. Items that are equal each give their own rows; a repeated item_id or doc_id
is reported once, with its least distance. Extra columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Params:
    rate: float = 0.05  #: edits for each character of an item
    piece: int = 12  #: least characters of a piece
    block: int = 2_000_000  #: characters of items that are broadcast at once


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(size: int, p: Params) -> int:
    return max(0, min(int(p.rate * size), size // p.piece - 1))


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their places."""
    ends = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def distance(item: str, text: str, k: int) -> int:
    """The least edit distance of ``item`` from any stretch of ``text``, or k + 1 if above k.

    Myers' algorithm with one machine word of as many bits as the item has characters.
    """
    m, peq = len(item), {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & ones, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & ones, mh << 1 & ones  # an occurrence may start anywhere
        pv, mv = mh | ~(xv | ph) & ones, ph & xv
        if score < best:
            best = score
            if not best:
                break
    return min(best, k + 1)


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], p: Params):
        self.params = p
        self.items = [(i, t, budget(len(t), p)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in cut(t, k):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Item ids that occur in the (normalised) text, with their least distances."""
        if not self.items or not text:
            return {}
        stretches: dict[int, list[list[int]]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for n, at in found:
                _, item, k = self.items[n]
                start = end + 1 - size - at
                a, b = max(0, start - k), start + len(item) + k
                own = stretches.setdefault(n, [])
                if own and a <= own[-1][1] and b - own[-1][0] <= 4 * len(item):
                    own[-1][0], own[-1][1] = min(a, own[-1][0]), max(b, own[-1][1])
                else:
                    own.append([a, b])
        out: dict[int, int] = {}
        for n, ranges in stretches.items():
            i, item, k = self.items[n]
            if item in text:
                d = 0
            else:
                d = min(distance(item, text[a:b], k) for a, b in ranges)
            if d <= k:
                out[i] = min(d, out.get(i, d))
        return out


def blocks(spark: SparkSession, benchmark: DataFrame, p: Params) -> Iterator[Matcher]:
    """Matchers that together hold every item, each of a bounded number of characters."""
    rows = benchmark.where("item_id is not null and trim(text) <> ''").select("item_id", "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + chars // p.block
    for i in range(n):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        items = sorted((r["item_id"], normalise(r["text"])) for r in own.toLocalIterator())
        yield Matcher([x for x in items if x[1]], p)


def found_in(spark: SparkSession, matcher: Matcher, text: str | Column) -> Column:
    """array of (item_id, distance) for the items of one matcher that occur in a text column."""
    items = spark.sparkContext.broadcast([(i, t) for i, t, _ in matcher.items])
    params = matcher.params

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())])))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Matcher(items.value, params)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d} for i, d in sorted(own.find(normalise(t)).items())] for t in texts], dtype=object)

    return find(text)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, item_id and edit distance of every occurrence of an item in a document."""
    out = spark.createDataFrame([], "doc_id long, item_id long, distance int")
    for matcher in blocks(spark, benchmark, params):
        hits = docs.select("doc_id", F.explode(found_in(spark, matcher, F.col("text"))).alias("hit"))
        out = out.union(hits.select("doc_id", "hit.item_id", "hit.distance"))
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents in which no item occurs, with all their columns; texts are never shuffled."""
    for matcher in blocks(spark, benchmark, params):
        docs = docs.where(F.size(found_in(spark, matcher, F.col("text"))) == 0)
    return docs

"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of five-word shingles. The weight of a shingle is its count in the
document (TF) times the mean inverse document frequency of its words (IDF). Document frequencies
are counted over all documents, in 2**16 hashed slots, which bounds what is broadcast. Word
frequencies are used rather than those of whole shingles because a large group of near copies
would give its own shingles a low weight and so hide itself.

Each document gets ``bands * rows`` consistent weighted samples (r and c from Gamma(2, 1), beta
uniform; the least ln a of each sample identifies its shingle and quantised weight). Documents
whose samples agree in a whole band share a bucket. In each bucket one pivot, the member with
the most neighbours over all bands, is compared with the others by exact weighted Jaccard
similarity. Buckets of ``small`` members or less that are not in one class by then are compared
pair by pair. In larger ones the rest is joined exactly, without pairing unlike members:

With D(x, y) the sum of |x - y| over all shingles and W the sum of weights, similarity s or more
means D(x, y) <= c (W(x) + W(y)), c = (1 - s) / (1 + s). Let a(x) = x - pivot, signed shingles, so
that D(x, y) is the distance of a(x) and a(y), and |a| the sum of its sizes. If y is not similar
to the pivot then D(y, pivot) > c (W(y) + W(pivot)), so x and y can only be similar if they share
at least (|a(x)| + c (W(pivot) - W(x))) / 2 of their differences from the pivot. Two documents
that do share a difference among the first of each, up to that much being left, in any one order
of all differences; those that many members have stand last. Members similar to the pivot are
met only with those that are not, whose list then goes on until (|a(y)| - c (W(pivot) + W(y))) / 2
is left. A pair is only made where what is left of both, from the shared difference on, is enough
for these two: (|a(x)| + |a(y)| - c (W(x) + W(y))) / 2, as it is at the first one they share. So documents that share a bucket and are similar are always in one class.

Hot keys are dealt over parts in every join. Links of at least ``threshold`` give the classes,
found by repeated contraction to the least neighbour.

Exact copies are one text with many ids; only one of them is sampled and compared.

Defined results: documents without a word (null, empty, blank) are classes of their own. Texts
of one to four words have one shingle, all their words. Repeated rows are copies of each other.
The class id is the least doc_id of the class, or null if it has none. Classes are found by text:
rows with a null doc_id or with the same doc_id and different texts belong where their texts do.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, attach, pieces
from .kernels import BASE, Words, mix, windows, words


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 12
    rows: int = 4
    idf_bits: int = 16
    small: int = 16  #: members of a bucket that is compared pair by pair
    often: float = 1 / 16  #: share of a pivot's members that makes a difference a frequent one
    part: int = 256  #: members of a part of a large group, about
    seed: int = 11


# --- weighted shingles -------------------------------------------------------------------


@lru_cache(maxsize=1)
def _draws(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of r, beta and ln c; a shingle picks its rows by two parts of its hash."""
    rng, size = np.random.default_rng(seed), 1 << 14
    r = rng.gamma(2, 1, (size, samples)).astype(np.float32)
    beta = rng.random((size, samples), np.float32)
    return np.maximum(r, 1e-4), beta, np.log(rng.gamma(2, 1, (size, samples))).astype(np.float32)


def shingles(w: Words, idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit hash and weight of each different shingle of each row, in order of row."""
    rows = len(w.first) - 1
    own = idf[(w.hash & np.uint64(len(idf) - 1)).astype(np.int64)].astype(np.float64)
    total = np.concatenate(([0.0], np.cumsum(own)))
    h, at = windows(w.hash, w.doc, n)
    doc, mean = w.doc[at], (total[at + n] - total[at]) / n
    count = np.diff(w.first)
    for row in np.flatnonzero((count > 0) & (count < n)):  # one shingle of all words
        a, b = w.first[row], w.first[row + 1]
        whole = np.full(1, b - a, np.uint64)
        for i in range(a, b):
            whole = whole * BASE + w.hash[i : i + 1]
        h, doc, mean = np.append(h, mix(whole)), np.append(doc, row), np.append(mean, own[a:b].mean())
    place = np.uint64(64 - int(rows).bit_length())
    key = (doc.astype(np.uint64) << place) | (h >> (np.uint64(64) - place))
    key, at, tf = np.unique(key, return_index=True, return_counts=True)
    # An IDF in steps of 1/64 is the same in every text, whatever order it was summed in.
    return doc[at], h[at], tf * (np.round(mean[at] * 64) / 64)


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, p: Params) -> np.ndarray:
    """The least ln a of each sample, for each row; rows without a shingle get infinity."""
    out = np.full((rows, p.bands * p.rows), np.inf, np.float32)
    r, beta, ln_c = _draws(p.bands * p.rows, p.seed)
    ln_s = np.log(weight).astype(np.float32)[:, None]
    one, two = (h & np.uint64(0x3FFF)).astype(np.int64), (h >> np.uint64(14) & np.uint64(0x3FFF)).astype(np.int64)
    for a in range(0, len(h), 4096):
        b = min(a + 4096, len(h))
        rr, bb = r[one[a:b]], beta[one[a:b]]
        t = np.floor(ln_s[a:b] / rr + bb)
        ln_a = ln_c[two[a:b]] - rr * (t - bb) - rr
        own, start = np.unique(doc[a:b], return_index=True)
        out[own] = np.minimum(out[own], np.minimum.reduceat(ln_a, start, axis=0))
    return out


def band_keys(sample: np.ndarray, p: Params) -> np.ndarray:
    bits = sample.view(np.uint32).astype(np.uint64).reshape(len(sample), p.bands, p.rows)
    key = np.arange(p.bands, dtype=np.uint64)[None, :] + np.zeros((len(sample), 1), np.uint64)
    for i in range(p.rows):
        key = mix(key * BASE + bits[:, :, i])
    return key.view(np.int64)


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum()
    return float(low / max(wa.sum() + wb.sum() - low, 1e-12))


# --- passes over the documents -----------------------------------------------------------


def word_idf(spark: SparkSession, docs: DataFrame, p: Params) -> np.ndarray:
    """IDF by hashed word, from the document frequencies over all documents.

    Each task adds its documents into 2**idf_bits counters; the sums of those are the only rows
    that reach the driver.
    """
    size = 1 << p.idf_bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(size, np.int64), 0
        for x in batches:
            texts = [t or "" for t in x["text"]]
            rows += len(texts)
            for a, b in pieces(texts):
                w = words(texts[a:b])
                slot = (w.hash & np.uint64(size - 1)).astype(np.int64)
                total += np.bincount(np.unique(w.doc * size + slot) % size, minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": np.append(at, -1), "n": np.append(total[at], rows)})

    counted = docs.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df, n = np.zeros(size), float(counted.loc[counted.slot == -1, "n"].sum())
    known = counted[counted.slot >= 0]
    df[known.slot.to_numpy()] = known.n
    return (1 + np.log((1 + n) / (1 + df))).astype(np.float32)


def text_key() -> Column:
    """128 bits of a hash of the text, as hexadecimal digits; empty for a null text."""
    return F.coalesce(F.substring(F.sha2(F.col("text"), 256), 1, 32), F.lit(""))


def sign(docs: DataFrame, idf: Broadcast, p: Params) -> DataFrame:
    """doc_id, hash of the text, content (the same, but null if no word) and band keys of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts = [t or "" for t in x.pop("text")]
            keys, filled = [], []
            for a, b in pieces(texts):
                w = words(texts[a:b])
                doc, h, weight = shingles(w, idf.value, p.shingle)
                keys += list(band_keys(samples(doc, h, weight, b - a, p), p))
                filled += list(np.diff(w.first) > 0)
            yield x.assign(content=[h if f else None for h, f in zip(x["hash"], filled, strict=True)], keys=keys)

    return docs.select("doc_id", text_key().alias("hash"), "text").mapInPandas(run, "doc_id long, hash string, content string, keys array<long>")


def vectors_of(docs: DataFrame, idf: Broadcast, p: Params) -> DataFrame:
    """doc_id and the packed shingles (sorted 32-bit hashes, then 32-bit weights) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts, packed = [t or "" for t in x["text"]], []
            for a, b in pieces(texts):
                doc, h, weight = shingles(words(texts[a:b]), idf.value, p.shingle)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                short = (h >> np.uint64(32)).astype(np.uint32)
                for i in range(b - a):
                    part = slice(cut[i], cut[i + 1])
                    one, back = np.unique(short[part], return_inverse=True)
                    packed.append(one.tobytes() + np.bincount(back, weight[part], len(one)).astype(np.float32).tobytes())
            yield pd.DataFrame({"doc_id": x["doc_id"], "packed": packed})

    rows = docs.select("doc_id", "text")
    return rows.mapInPandas(run, f"doc_id {rows.dtypes[0][1]}, packed binary")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: bytes, y: bytes) -> float:
        (ha, wa), (hb, wb) = ((np.frombuffer(v, np.uint32, len(v) // 8), np.frombuffer(v, np.float32, len(v) // 8, len(v) // 2)) for v in (x, y))
        return weighted_jaccard(ha, wa, hb, wb)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def weight(packed: pd.Series) -> pd.Series:
    return pd.Series([float(np.frombuffer(v, np.float32, len(v) // 8, len(v) // 2).sum()) for v in packed], dtype=float)


# --- links and classes -------------------------------------------------------------------


def _unpacked(v: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(v, np.uint32, len(v) // 8), np.frombuffer(v, np.float32, len(v) // 8, len(v) // 2).astype(np.float64)


def against_pivots(p: Params):
    """A column function of (document, pivot, whether its bucket is large): whether they are linked, and how they differ.

    The differences are signed shingles (twice the hash, plus one where the pivot has more) and
    their sizes, packed; ``short`` and ``long`` say how much of them is not needed in a prefix.
    """

    @F.pandas_udf("linked boolean, differences binary, short double, long double")
    def compare(x: pd.Series, pivot: pd.Series, large: pd.Series) -> pd.DataFrame:
        c, out = (1 - p.threshold) / (1 + p.threshold), []
        for vx, vp, big in zip(x, pivot, large, strict=True):
            (hx, wx), (hp, wp) = _unpacked(vx), _unpacked(vp)
            linked = weighted_jaccard(hx, wx, hp, wp) >= p.threshold
            if not big:
                out.append((linked, None, None, None))
                continue
            every, back = np.unique(np.concatenate((hx, hp)), return_inverse=True)
            gap = np.bincount(back, np.concatenate((wx, -wp)), len(every))
            at = np.flatnonzero(gap)
            token, size = every[at].astype(np.int64) * 2 + (gap[at] < 0), np.abs(gap[at])
            spare = 1e-3 * (wx.sum() + wp.sum())  # for rounding
            short = (size.sum() + c * (wp.sum() - wx.sum())) / 2 - spare
            long = (size.sum() - c * (wp.sum() + wx.sum())) / 2 - spare
            out.append((linked, token.tobytes() + size.tobytes(), short, short if linked else min(short, long)))
        return pd.DataFrame(out, columns=["linked", "differences", "short", "long"])

    return compare


def _differences(v: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(v, np.int64, len(v) // 16), np.frombuffer(v, np.float64, len(v) // 16, len(v) // 2)


def frequent_differences(rows: DataFrame, often: float) -> DataFrame:
    """pivot, token and n, the number of members of the pivot that have this difference, for the frequent ones.

    Each part of a pivot's members names those that more than half of ``often`` of its members have, and two at
    least: a bounded number of times what a member has, however large the group is. So n is too low by half of
    ``often`` of the members and one a part at most. Any n is right for the links: it only orders the differences.
    """

    def count(part: pd.DataFrame) -> pd.DataFrame:
        token, n = np.unique(np.concatenate([_differences(v)[0] for v in part["differences"]]), return_counts=True)
        kept = n > max(1, often / 2 * len(part))
        return pd.DataFrame({"pivot": part["pivot"].iloc[0], "token": token[kept], "n": n[kept]})

    kind = dict(rows.dtypes)["pivot"]
    named = rows.select("pivot", "part", "differences").groupBy("pivot", "part").applyInPandas(count, f"pivot {kind}, token long, n long")
    return named.groupBy("pivot", "token").agg(F.sum("n").alias("n"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.LongType()), *(T.StructField(k, T.BooleanType()) for k in ("often", "short")), *(T.StructField(k, T.DoubleType()) for k in ("left", "size"))])))
def prefix(differences: pd.Series, short: pd.Series, long: pd.Series, frequent: pd.Series) -> pd.Series:
    """The first differences, frequent ones last, until ``long`` is left; whether it is frequent and ``short`` is left; what is left; and of how much."""
    out = []
    for v, a, b, last in zip(differences, short, long, frequent, strict=True):
        token, size = _differences(v)
        times = dict((t["token"], t["n"]) for t in last) if last is not None else {}
        order = np.lexsort((token, [times.get(t, 0) for t in token.tolist()]))
        left = size.sum() - np.concatenate(([0.0], np.cumsum(size[order])[:-1]))
        out.append([{"token": t, "often": t in times, "short": bool(n >= a), "left": float(n), "size": float(size.sum())} for t, n in zip(token[order].tolist(), left, strict=True) if n >= b])
    return pd.Series(out, dtype=object)


def sharing(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of each ``group`` that holds two or more, not all linked, with n, how many it holds; without ``often``.

    Most differences are one member's own, so those that are not frequent ones, at most about a tenth of a pivot's
    members each, are counted where they meet, and only the rows of shared ones come out of that one shuffle.
    """
    own = Window.partitionBy("group")
    seldom = rows.where("not often").withColumns({"n": F.count("*").over(own), "all": F.min("linked").over(own)})
    often = rows.where("often")
    groups = scratch.keep(often.groupBy("group").agg(F.count("*").alias("n"), F.min("linked").alias("all")).where("n > 1 and not all").drop("all"), "groups")
    return attach(often, groups, "group", "n").unionByName(seldom.where("n > 1 and not all").drop("all")).drop("often")


def links(spark: SparkSession, docs: DataFrame, unique: DataFrame, idf: Broadcast, p: Params, scratch: Scratch) -> DataFrame:
    """Verified links (a, b) between different texts, ``unique`` holding doc_id and band keys.

    Here a doc_id is any key of one text; ``docs`` has its text.
    """

    def dealt(rows: DataFrame, key: str) -> DataFrame:
        """Rows with parts, the number of parts of their key, and part."""
        n = scratch.keep(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "counted")
        rows = attach(rows, n, key, "n").withColumn("parts", F.ceil(F.col("n") / p.part).cast("int"))
        return rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))

    def copied(groups: DataFrame) -> DataFrame:
        """A copy of each group for each of its parts."""
        return groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def compare(pairs: DataFrame) -> DataFrame:
        pairs = scratch.keep(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        one = vectors.select(F.col("doc_id").alias("a"), F.col("packed").alias("va"))
        two = vectors.select(F.col("doc_id").alias("b"), F.col("packed").alias("vb"))
        return scratch.keep(pairs.join(two, "b").join(one, "a").select("a", "b", (similarity("va", "vb") >= p.threshold).alias("linked")), "tested")

    def ends(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    member = scratch.keep(dealt(unique.select("doc_id", F.explode("keys").alias("key")), "key"), "member")
    centre = member.groupBy("doc_id").agg(F.sum("n").alias("near"))
    vectors = scratch.keep(vectors_of(docs.join(centre.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), idf, p), "vectors")
    # The pivot of a bucket: the member with the most neighbours, the greatest id of several.
    top = member.join(centre, "doc_id").groupBy("key").agg(F.max(F.struct("near", "doc_id")).alias("top"), F.max("parts").alias("parts"))
    member = member.join(copied(top.select("key", "parts", F.col("top.doc_id").alias("pivot"))).drop("parts"), ["key", "part"])
    member = scratch.keep(member.select("key", "pivot", "doc_id", "n", "parts", "part"), "pivots")
    pairs = member.where("doc_id <> pivot").groupBy("pivot", "doc_id").agg(F.max(F.col("n") > p.small).alias("large"))
    # A pivot of one document only needs no parts, so it is added to those that dealt keeps.
    pairs = scratch.keep(pairs, "pairs")
    times = scratch.keep(pairs.groupBy("pivot").agg(F.count("*").alias("n")), "times")
    pairs = attach(pairs, times, "pivot", "n").withColumn("parts", F.ceil(F.col("n") / p.part).cast("int"))
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("n")
    centres = times.join(vectors.withColumnsRenamed({"doc_id": "pivot", "packed": "centre"}), "pivot")
    centres = copied(centres.select("pivot", "centre", F.ceil(F.col("n") / p.part).cast("int").alias("parts"))).drop("parts")
    met = pairs.join(vectors, "doc_id").join(centres, ["pivot", "part"])
    met = met.withColumn("found", against_pivots(p)("packed", "centre", "large")).select("pivot", "doc_id", "large", "parts", "part", "found.*")
    met = scratch.keep(met, "met")
    tested = met.select(*ends("pivot", "doc_id"), "linked").distinct()

    joined = components(tested.where("linked").select("a", "b"), scratch).withColumnRenamed("class_id", "own")
    size = vectors.select("doc_id", weight("packed").alias("weight"))
    sized = scratch.keep(size.join(joined, "doc_id", "left").withColumn("own", F.coalesce("own", "doc_id")), "sized")

    def sides(rows: DataFrame, on: list[str], more: list[str]) -> DataFrame:
        """Pairs of rows in different classes whose weights alone do not rule a link out (with a margin for rounding)."""
        x, y = (rows.select(*on, *(F.col(c).alias(c + side) for c in ("doc_id", "own", "weight", *more))) for side in "xy")
        return x.join(y, on).where("ownx <> owny").where(F.least("weightx", "weighty") >= (p.threshold - 1e-3) * F.greatest("weightx", "weighty"))

    # Small buckets: the pairs of those that are in more than one class.
    few = member.where(F.col("n") <= p.small).select("key", "doc_id").join(sized, "doc_id")
    mixed = few.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("key")
    few = scratch.keep(few.join(mixed, "key"), "few")
    near = compare(sides(few, ["key"], []).where("doc_idx < doc_idy").select(*ends("doc_idx", "doc_idy")))

    # Large ones: those that share differences from a pivot that not all are linked with.
    large = met.where("large")
    mixed = large.groupBy("pivot").agg(F.min("linked").alias("all"), F.count("*").alias("n"), F.max("parts").alias("parts")).where("not all and n > 1")
    mixed = scratch.keep(mixed.drop("all"), "mixed")
    if mixed.isEmpty():
        return tested.union(near).where("linked").select("a", "b")
    large = scratch.keep(large.join(copied(mixed).drop("parts", "n"), ["pivot", "part"]), "large")
    frequent = frequent_differences(large, p.often).join(mixed.select("pivot", F.col("n").alias("members"), "parts"), "pivot").where(F.col("n") > p.often * F.col("members"))
    # At most 1 / often times as many as a member has on average.
    frequent = frequent.groupBy("pivot").agg(F.collect_list(F.struct("token", "n")).alias("frequent"), F.max("parts").alias("parts"))
    rows = large.join(copied(frequent).drop("parts"), ["pivot", "part"], "left")
    rows = rows.select("pivot", "doc_id", "linked", F.explode(prefix("differences", "short", "long", "frequent")).alias("at"))
    rows = scratch.keep(rows.select(F.xxhash64("pivot", "at.token").alias("group"), "doc_id", "linked", "at.often", "at.short", "at.left", "at.size"), "prefixes")
    rows = sharing(rows, scratch).withColumn("parts", F.ceil(F.col("n") / p.part).cast("int")).join(sized, "doc_id")
    # A large group is cut into parts; each pair of parts is a cell of its own.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = scratch.keep(rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}), "cells")
    pairs = sides(rows, ["group", "i", "j"], ["part", "linked", "short", "left", "size"]).where("(partx = party and doc_idx < doc_idy) or partx < party")
    pairs = pairs.where("(not linkedx or not linkedy) and (linkedx or linkedy or (shortx and shorty))")
    c, both = (1 - p.threshold) / (1 + p.threshold), F.col("weightx") + F.col("weighty")
    pairs = pairs.where(F.least("leftx", "lefty") >= (F.col("sizex") + F.col("sizey") - c * both) / 2 - 1e-3 * both)
    more = compare(pairs.select(*ends("doc_idx", "doc_idy")))
    return tested.union(near).union(more).where("linked").select("a", "b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and the least doc_id of its component, for every end of an edge.

    Every round each node moves to its least neighbour and the graph is contracted, so the number
    of nodes at least halves; rows stay distributed throughout.
    """
    edges = scratch.keep(edges.where("a <> b").distinct(), "edges")
    found = scratch.keep(edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().select("doc_id", F.col("doc_id").alias("class_id")), "found")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")), "parent")
        while True:  # follow parents to a root
            top = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = scratch.keep(parent.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parent")
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        moved = found.join(parent.withColumnRenamed("node", "class_id"), "class_id", "left")
        found = scratch.keep(moved.select("doc_id", F.coalesce("up", "class_id").alias("class_id")), "found")
        a, b = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = scratch.keep(edges.join(a, "a").join(b, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")).where("a <> b").distinct(), "edges")
    return found


def grouped(spark: SparkSession, docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, hash of the text, root (the class by a text's hash, null if no word) and class_id of every row."""
    scratch = Scratch(spark, "near-dedup")
    idf = spark.sparkContext.broadcast(word_idf(spark, docs, params))  # 2**idf_bits floats
    signed = scratch.keep(sign(docs, idf, params), "signed")
    copies = signed.where("content is not null").groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = scratch.keep(copies, "copies")
    # Of each text one row is read again: a text's keys, shingles and class hang on its hash, not on an id.
    read = F.expr("doc_id <=> first")
    unique = signed.join(copies.withColumnRenamed("content", "own"), read & (F.col("content") == F.col("own")), "left_semi").dropDuplicates(["content"])
    unique = scratch.keep(unique.select(F.col("content").alias("doc_id"), "keys"), "unique")
    texts = docs.select("doc_id", "text").withColumn("content", text_key())
    texts = texts.join(copies.withColumnRenamed("content", "own"), read & (F.col("content") == F.col("own")), "left_semi")
    found = components(links(spark, texts.select(F.col("content").alias("doc_id"), "text"), unique, idf, params, scratch), scratch)
    named = copies.join(found.select(F.col("doc_id").alias("content"), F.col("class_id").alias("root")), "content", "left")
    named = scratch.keep(named.withColumn("root", F.coalesce("root", "content")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    named = scratch.keep(named.join(least, "root").select("content", "n", "root", "class_id"), "named")
    rows = signed.select("doc_id", "hash", "content")
    result = attach(rows.where("content is not null"), named, "content", "n").select("doc_id", "hash", "root", "class_id")
    empty = rows.where("content is null").select("doc_id", "hash", F.lit(None).cast("string").alias("root"), F.col("doc_id").alias("class_id"))
    result = scratch.keep(result.union(empty), "result")
    scratch.close("result")
    return result


def classes(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id and class_id of every row of ``docs`` (doc_id, text)."""
    return grouped(spark, docs, params).select("doc_id", "class_id")


def keep_one(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One document of each class, the one with the least doc_id, with all its columns.

    A class without any doc_id keeps one of its rows; texts that share a doc_id are told apart.
    """
    found = grouped(spark, docs, params)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("kept")
    kept = found.where("root is not null").groupBy("root").agg(first).select("kept.doc_id", "kept.hash")
    kept = kept.union(found.where("root is null").select("doc_id", "hash").distinct())
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("hash").alias("_kept_hash"))
    rows = docs.withColumn("_hash", text_key())
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_kept_id"]) & (rows["_hash"] == kept["_kept_hash"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_hash"]).select(docs.columns)

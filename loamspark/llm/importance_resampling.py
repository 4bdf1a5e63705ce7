"""Documents drawn by importance for a target distribution: hashed n-gram features and Gumbel noise.

Features are all runs of one to three words. A distinct-feature dictionary holds each n-gram string
once: every task counts the different strings of its documents, in chunks of words; the strings and
their counts are dealt over parts by a hash of their first word, compressed; each part adds up the counts
of equal strings and hashes each different one once into its bucket; the buckets are summed. So the source
(all documents) and the target (all benchmark texts) have one count for each bucket, and each bucket
a gain, the logarithm of how much likelier the target makes it. The gains, one row for each bucket,
are joined back to the feature counts of each document, again hashing a string once in a chunk.

Scores are weights plus Gumbel noise of the document's id, so the highest scores are a sample
without replacement in proportion to the weights. Ranks are given by a range partitioning of the
scores and the number of rows before each range; no task sees all documents.

Defined results: null texts have no features and weight 0, as have texts without a word. Rows with
fewer than ``least_words`` words keep their score but are never drawn. Equal scores are ordered by
doc_id, a null doc_id (whose noise is that of an empty id) last; repeated rows each have their own
rank, in any order. Extra columns are ignored. Empty tables give an empty result; an empty target or
source counts as none of any feature.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices
from .kernels import BASE, mix
from .strings import Words, crc32, places, words_of


@dataclass(frozen=True)
class Params:
    longest: int = 3  #: words of a feature
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 5  #: of the documents that are long enough
    seed: int = 42
    block: int = 8_000_000  #: characters of a block of texts, about
    chunk: int = 2_000_000  #: words whose features are counted at once
    followers: int = 64  #: longest features of a chunk that start with the same words, beyond which more words deal them
    part: int = 16_000_000  #: characters of the texts for each part of the dictionary, about


class Features(NamedTuple):
    """Different features of n words of a chunk, in order of their words' numbers."""

    word: list[np.ndarray]  #: numbers of the 1st, 2nd ... word of each
    count: np.ndarray
    first: np.ndarray  #: word at which each occurrence starts
    number: np.ndarray | None  #: of the feature of each occurrence


def chunks(w: Words, p: Params, numbered: bool) -> Iterator[tuple[pa.Array, list[Features]]]:
    """The dictionary of each chunk of words and its features, by length; features start in the chunk."""
    last = np.repeat(w.first[1:], np.diff(w.first))  # number of the word after each word's text
    for a in range(0, len(w.words), p.chunk):
        z = min(a + p.chunk, len(w.words))
        found = w.words.slice(a, z - a + p.longest - 1).dictionary_encode()
        order = np.argsort(-np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)), kind="stable")  # the most frequent first: small numbers
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        ids = moved[found.indices.to_numpy()]
        dictionary, out = found.dictionary.take(pa.array(order)), []
        base = np.int64(len(dictionary))
        key, first = ids[: z - a], np.arange(a, z)
        for n in range(1, p.longest + 1):
            if n > 1:
                fits = first + n <= last[first]
                key, first = key[fits], first[fits]
                if float(base) ** n >= 2.0**63:
                    raise ValueError("a chunk has too many different words for its features to be numbered")
                key = key * base + ids[first - a + n - 1]
            if numbered:
                one, number, count = np.unique(key, return_inverse=True, return_counts=True)
            else:
                one, count = np.unique(key, return_counts=True)
                number = None
            out.append(Features([one // base**i % base for i in range(n - 1, -1, -1)], count, first, number))
        yield dictionary, out


def strings(dictionary: pa.Array, word: list[np.ndarray]) -> pa.Array:
    """The features as strings: their words, joined by a space."""
    own = [dictionary.take(pa.array(x)) for x in word]
    return own[0] if len(own) == 1 else pc.binary_join_element_wise(*own, pa.scalar(b" ", own[0].type))


def buckets(features: pa.Array, p: Params) -> np.ndarray:
    return (crc32(features) % np.uint32(p.buckets)).astype(np.int64)


# --- the dictionary ----------------------------------------------------------------------


def _least(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _key(word: list[np.ndarray], base: int) -> np.ndarray:
    key = word[0].astype(np.int64)
    for x in word[1:]:
        key = key * base + x
    return key


def _added(word: list[np.ndarray], count: np.ndarray, longer: list[np.ndarray], more: np.ndarray, base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and counts, with ``more`` added for the start of each longer feature; those that come to 0 are left out."""
    n = len(word)
    key, back = np.unique(np.concatenate((_key(word, base), _key(longer[:n], base))), return_inverse=True)
    total = np.bincount(back, np.concatenate((count, more)), len(key)).astype(np.int64)
    key, total = key[total != 0], total[total != 0]
    return [key // base**i % base for i in range(n - 1, -1, -1)], total


def _packed(dictionary: pa.Array, own: list[tuple[list[np.ndarray], np.ndarray]]) -> bytes:
    """Features of each length, as numbers of the words that occur here, and their counts, compressed.

    Of two words or more, only what a count differs from those of the longer features that start with it is kept:
    nothing for most, since a part holds the longer ones too.
    """
    used, number = np.unique(np.concatenate([x for word, _ in own for x in word]), return_inverse=True)
    offsets, data = places(dictionary.take(pa.array(used)))
    each = np.split(number, np.cumsum([len(x) for word, _ in own for x in word])[:-1])
    own = [([each.pop(0) for _ in word], count) for word, count in own]
    arrays = [np.diff(offsets), data[offsets[0] : offsets[-1]]]
    for n, (word, count) in enumerate(own, 1):
        if 1 < n < len(own):
            longer, more = own[n]
            word, count = _added(word, count, longer, -more, len(used))
        arrays += [(count << 1) ^ (count >> 63), np.diff(word[0], prepend=0), *word[1:]]  # signs last; in order of the first word
    arrays = [_least(x) for x in arrays]
    head = np.array([len(arrays), *(v for x in arrays for v in (x.itemsize, len(x)))], np.uint32)
    raw = head.tobytes() + b"".join(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays)  # bytes of one place together
    return len(raw).to_bytes(8, "little") + bytes(pa.Codec("zstd", 3).compress(raw))


def _unpacked(value: bytes, k: int) -> tuple[pa.Array, np.ndarray]:
    """The features of k words as strings, and their counts."""
    raw = bytes(pa.Codec("zstd").decompress(value[8:], int.from_bytes(value[:8], "little")))
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    head = np.frombuffer(raw, np.uint32, 2 * n, 4).astype(np.int64).reshape(n, 2)
    place = 4 + 8 * n + np.concatenate(([0], np.cumsum(head.prod(axis=1))))

    def array(i: int) -> np.ndarray:
        planes = np.frombuffer(raw, np.uint8, place[i + 1] - place[i], place[i]).reshape(head[i, 0], -1)
        return np.ascontiguousarray(planes.T).view(f"u{head[i, 0]}").ravel().astype(np.int64)

    def features(k: int) -> tuple[list[np.ndarray], np.ndarray]:
        at = 2 + sum(range(2, k + 1))  # before: a column of counts and one for each word, of each smaller length
        count, word = array(at), [np.cumsum(array(at + 1)), *(array(at + 1 + i) for i in range(1, k))]
        count = (count >> 1) ^ -(count & 1)
        return _added(word, count, *features(k + 1), len(lengths)) if k > 1 and at + 1 + k < n else (word, count)

    lengths = array(0)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[place[1] : place[2]])])
    word, count = features(k)
    return strings(words, word), count


def _hash(word_hash: np.ndarray, word: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(word[0]), np.uint64)
    for x in word:
        h = h * BASE + word_hash[x] + np.uint64(1)
    return h


def followed(word: list[np.ndarray], p: Params) -> list[np.ndarray]:
    """The different rows of ``word``, sorted ones, that occur more than ``followers`` times."""
    first = np.flatnonzero(np.logical_or.reduce([np.diff(x, prepend=-1) != 0 for x in word]))
    first = first[np.diff(np.append(first, len(word[0]))) > p.followers]
    return [x[first] for x in word]


def counted_features(texts: DataFrame, parts: int, p: Params) -> DataFrame:
    """part and packed: the different features of each chunk with their counts, dealt over ``parts``.

    Features go where their first word does, so that a part seldom repeats a word or a shorter feature. Those of a word
    that starts many are dealt by their first two words, and those of such a pair by all: the same feature of two chunks
    may then lie in two parts, which changes no sum.
    """
    schema = pa.schema([("part", pa.int32()), ("packed", pa.binary())])

    def dealt(dictionary: pa.Array, own: list[Features]) -> Iterator[tuple[int, bytes]]:
        word_hash, out = crc32(dictionary).astype(np.uint64), []
        heavy, pair = followed(own[-1].word[:1], p), followed(own[-1].word[:2], p)
        for f in own:
            h = _hash(word_hash, f.word[:1])
            if len(f.word) > 1:
                h = np.where(np.isin(f.word[0], heavy[0]), _hash(word_hash, f.word[:2]), h)
            if len(f.word) > 2:
                base = np.int64(len(dictionary))
                h = np.where(np.isin(_key(f.word[:2], base), _key(pair, base)), _hash(word_hash, f.word), h)
            part = (mix(h) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            out.append(([x[order] for x in f.word], f.count[order], np.searchsorted(part[order], np.arange(parts + 1))))
        for k in np.flatnonzero(sum(np.diff(edge) for _, _, edge in out)).tolist():
            yield k, _packed(dictionary, [([x[edge[k] : edge[k + 1]] for x in word], count[edge[k] : edge[k + 1]]) for word, count, edge in out])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
        """Texts of several batches, as long as they fit a block."""
        held, size = [], 0
        for x in batches:
            for _, texts in slices(x, p.block):
                more = sum(len(t) + 1 for t in texts)
                if held and size + more > p.block:
                    yield held
                    held, size = [], 0
                held, size = held + texts, size + more
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for chunk in chunks(words_of(block), p, False):
                for k, packed in dealt(*chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], schema=schema)
            pa.default_memory_pool().release_unused()

    return texts.select(F.lit(0).alias("none"), "text").mapInArrow(run, "part int, packed binary")


def bucket_counts(texts: DataFrame, p: Params = Params()) -> np.ndarray:
    """How many features of all texts fall into each bucket, by the distinct-feature dictionary."""
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / p.part))

    def merge(rows: pa.Table) -> pa.Table:
        packed, total = rows["packed"].to_pylist(), np.zeros(p.buckets, np.int64)
        for k in range(1, p.longest + 1):  # features of different lengths are never equal
            each = [_unpacked(v, k) for v in packed]
            for r in range(4):  # equal features are equally long, so a quarter of the strings is numbered at a time
                own = [np.diff(places(x)[0]) % 4 == r for x, _ in each]
                n = np.concatenate([y[m] for (_, y), m in zip(each, own, strict=True)])
                if not len(n):
                    continue
                known = pa.chunked_array([x.filter(pa.array(m)) for (x, _), m in zip(each, own, strict=True)]).dictionary_encode().combine_chunks()
                count = np.bincount(known.indices.to_numpy(), n, len(known.dictionary)).astype(np.int64)
                known = known.dictionary
                for a in range(0, len(count), 1 << 17):
                    np.add.at(total, buckets(known.slice(a, 1 << 17), p), count[a : a + (1 << 17)])
                del known, own
            del each
            pa.default_memory_pool().release_unused()
        at = np.flatnonzero(total)
        return pa.table({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    found = counted_features(texts, parts, p).groupBy("part").applyInArrow(merge, "bucket int, n long")
    rows = found.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # a row for each bucket
    total = np.zeros(p.buckets, np.int64)
    total[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + n) / ((x + 1) * (t + n)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


# --- weights, scores, ranks --------------------------------------------------------------


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(texts: list[str], gain: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and the sum of gains of each text."""
    w = words_of(texts)
    n = np.diff(w.first)
    total = np.zeros(len(w.words) + 1, np.int64)
    for dictionary, own in chunks(w, p, True):
        for f in own:
            total[f.first + 1] += gain[buckets(strings(dictionary, f.word), p)][f.number]
    np.cumsum(total, out=total)
    features = sum(np.maximum(n - k, 0) for k in range(p.longest))
    return n, features, np.diff(total[w.first])


def scored(spark: SparkSession, docs: DataFrame, gain: np.ndarray, p: Params) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    shared = spark.sparkContext.broadcast(gain)  # one number for each bucket
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for ids, texts in slices(x, p.block // 5):
                n, features, weight = weigh(texts, shared.value, p)
                score = weight + np.array([noise(i, p.seed) for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids, n, features, weight, score)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def ranked(rows: DataFrame, drawn: int, scratch: Scratch) -> DataFrame:
    """``rows`` in ranges of falling score, with rank (null beyond ``drawn``)."""
    place = F.monotonically_increasing_id()  # number of the range, and of the row in it
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.keep(rows.withColumn("place", place), "ordered").withColumn("range", F.shiftright("place", 33).cast("int"))
    sizes = rows.groupBy("range").agg(F.count("*").alias("n")).toPandas().sort_values("range")  # a row for each range
    before = pd.DataFrame({"range": sizes["range"].astype("int32"), "before": (sizes["n"].cumsum() - sizes["n"]).astype("int64")})
    before = rows.sparkSession.createDataFrame(before, "range int, before long")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(before), "range").withColumn("rank", F.when(rank <= drawn, rank)).drop("range", "before", "place")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; the drawn rows have a rank."""
    scratch = Scratch(spark, "resampling")
    gain = gains(bucket_counts(docs, p), bucket_counts(target, p))
    rows = scratch.keep(scored(spark, docs, gain, p), "scored")
    fit = rows.where(F.col("n_words") >= p.least_words)
    rest = rows.where(F.col("n_words") < p.least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(fit, p.percent * fit.count() // 100, scratch).unionByName(rest)


def drawn(spark: SparkSession, docs: DataFrame, target: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of the drawn doc_ids with all their columns, and rank, the best of the id; an own column of that name is replaced."""
    scratch = Scratch(spark, "drawn")
    ids = scratch.keep(resample(spark, docs, target, p).where("rank is not null").select("doc_id", "rank"), "ranks")
    single = ids.groupBy("doc_id").agg(F.min("rank").alias("rank")).select(F.col("doc_id").alias("_id"), "rank")
    return docs.drop("rank").join(single, F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))).drop("_id")

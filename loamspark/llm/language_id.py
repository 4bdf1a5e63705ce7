"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character n-grams. Each language has several
centroids, found by spherical k-means over a bounded sample of its labelled texts; a text takes
the language of the centroid with the highest cosine. A text is rejected when that cosine is
clearly below those of the language's own labelled texts of about its length: below ``slack``
times their ``quantile``. Document frequencies and cosines are counted over all training rows.

Defined results: a null text or one without any letter is ``und``, rejected, score 0. Texts of
any length are read whole. Repeated rows are predicted alike; equal cosines take the first
language in alphabetical order. With no labelled text at all every row is ``und`` and rejected.
Only ``doc_id``, ``text`` and (for training) ``lang`` are read, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fold, pieces
from .kernels import code_points, mix


CLASSES, BINS = 40, 1000  #: of length and of cosines, in the counts over all training rows


@dataclass(frozen=True)
class Params:
    grams: tuple[int, ...] = (1, 2, 3)
    bits: int = 12  #: n-grams are hashed to 2**bits dimensions
    sample: int = 1500  #: labelled texts of a language that the centroids are fitted on, at most
    centroids: int = 3  #: per language
    rounds: int = 8  #: of k-means
    quantile: float = 0.002  #: a text is rejected below this quantile of the cosines seen in training,
    slack: float = 0.7  #: times this, for texts of a kind that training has not seen
    rows: int = 30  #: training rows that a quantile needs; a rarer length is taken with the next shorter ones
    seed: int = 7


@dataclass(frozen=True)
class Model:
    params: Params
    idf: np.ndarray
    langs: list[str]  #: of each centroid
    centroids: np.ndarray
    least: np.ndarray  #: cosine below which a text is rejected, of each centroid and class of length


def gram_counts(texts: list[str], p: Params) -> np.ndarray:
    """Counts of hashed n-grams of lower-cased letters, words bounded by one blank."""
    size, out = 1 << p.bits, np.zeros((len(texts), 1 << p.bits), np.float32)
    for a, b in pieces(texts):
        low = [t.lower() for t in texts[a:b]]
        chars = code_points(" ".join(low) + " ").astype(np.uint64)
        doc = np.repeat(np.arange(b - a), [len(t) + 1 for t in low])
        letter = (chars >= 97) & (chars <= 122) | (chars >= 0xC0) & (chars != 0xD7) & (chars != 0xF7)
        chars = np.where(letter, chars, np.uint64(32))
        keep = letter | np.concatenate(([False], letter[:-1]))  # one blank after a word
        chars, doc = chars[keep], doc[keep]
        total = np.zeros((b - a) * size)
        for n in p.grams:
            if len(chars) < n:
                continue
            h = np.full(len(chars) - n + 1, np.uint64(n))
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + chars[i : len(chars) - n + 1 + i]
            ok = doc[: len(h)] == doc[n - 1 :]
            slot = (mix(h) >> np.uint64(64 - p.bits)).astype(np.int64) + doc[: len(h)] * size
            total += np.bincount(slot[ok], minlength=len(total))
        out[a:b] = total.reshape(b - a, size)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def lengths(counts: np.ndarray) -> np.ndarray:
    """The class of length of each row of counts: half powers of two of its number of n-grams."""
    return np.minimum(2 * np.log2(1 + counts.sum(1)), CLASSES - 1).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _kmeans(v: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; the start points are drawn far from each other."""
    centre = v[[0]]
    while len(centre) < min(k, len(v)):
        far = np.maximum(1 - (v @ centre.T).max(1), 0) + 1e-9
        centre = np.vstack([centre, v[rng.choice(len(v), p=far / far.sum())]])
    for _ in range(rounds):
        own = (v @ centre.T).argmax(1)
        centre = np.vstack([v[own == i].sum(0) if (own == i).any() else centre[i] for i in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def _frequencies(rows: DataFrame, p: Params) -> tuple[np.ndarray, int]:
    """In how many rows each hashed n-gram occurs, and the number of rows; tasks add up before the shuffle."""
    size = 1 << p.bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 1, np.int64)
        for x in batches:
            for a in range(0, len(x), 256):
                counts = gram_counts(list(x["text"][a : a + 256]), p)
                total += np.append((counts > 0).sum(0), len(counts))
        yield pd.DataFrame({"slot": np.arange(size + 1), "n": total})

    total = np.zeros(size + 1, np.int64)
    for r in rows.select("text").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        total[r["slot"]] = r["n"]
    return total[:size], int(total[size])


def _bounds(rows: DataFrame, m: Model) -> dict[str, np.ndarray]:
    """The least accepted cosine of each language and class of length, from all training rows."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        own = {lang: m.centroids[[x == lang for x in m.langs]].T for lang in set(m.langs)}
        total: dict[str, np.ndarray] = {lang: np.zeros(CLASSES * BINS, np.int64) for lang in own}
        for x in batches:
            for lang, texts in x.groupby("lang")["text"]:
                for a in range(0, len(texts), 256) if lang in own else ():
                    counts = gram_counts(list(texts[a : a + 256]), m.params)
                    cosine = (vectors(counts, m.idf) @ own[lang]).max(1)
                    bins = np.clip(cosine * BINS, 0, BINS - 1).astype(np.int64)
                    total[lang] += np.bincount(lengths(counts) * BINS + bins, minlength=CLASSES * BINS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "at": at, "n": n[at]})

    seen = {lang: np.zeros((CLASSES, BINS)) for lang in m.langs}
    counted = rows.mapInPandas(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most CLASSES * BINS rows a language
        seen[r["lang"]][r["at"] // BINS, r["at"] % BINS] = r["n"]
    out = {}
    for lang, n in seen.items():
        low = np.zeros(CLASSES)
        for k in range(CLASSES):
            first = k
            while first and n[first : k + 1].sum() < m.params.rows:
                first -= 1
            part = n[first : k + 1].sum(0).cumsum()
            # Lengths without enough rows of their own or shorter keep the lowest cosine seen at all.
            part = part if part[-1] >= m.params.rows else n.sum(0).cumsum()
            low[k] = np.searchsorted(part, max(1, m.params.quantile * part[-1])) / BINS
        out[lang] = m.params.slack * low
    return out


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    """Learn from the rows of ``docs`` (text, lang), all of which are taken as training rows.

    The centroids' sample is the ``params.sample`` different texts of each language that come first
    by a hash of the text, so its size is bounded by languages times sample, whatever the input.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.5 * params.sample / n)).otherwise(share)
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    drawn = rows.where(place < share * 1_000_003).dropDuplicates()
    drawn = drawn.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(place, "text"))).where(F.col("rank") <= params.sample)
    got: dict[str, list[str]] = {lang: [] for lang in sorted(sizes)}
    for r in drawn.toLocalIterator():
        if has_letter(r["text"]):
            got[r["lang"]].append(r["text"])
    got = {lang: sorted(texts) for lang, texts in got.items() if texts}
    size = 1 << params.bits
    if not got:
        return Model(params, np.ones(size, np.float32), [], np.zeros((0, size), np.float32), np.zeros((0, CLASSES)))
    df, n = _frequencies(rows, params)
    idf = (1 + np.log((1 + n) / (1 + df))).astype(np.float32)
    rng, langs, centroids = np.random.default_rng(params.seed), [], []
    for lang, texts in got.items():
        centre = _kmeans(vectors(gram_counts(texts, params), idf), params.centroids, params.rounds, rng)
        langs += [lang] * len(centre)
        centroids.append(centre)
    model = Model(params, idf, langs, np.vstack(centroids).astype(np.float32), np.zeros((len(langs), CLASSES)))
    least = _bounds(rows, model)
    return replace(model, least=np.array([least[lang] for lang in langs]))


def score_texts(texts: list[str | None], m: Model) -> tuple[list[str], list[float], list[bool]]:
    names, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    at = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if m.langs else []
    for a in range(0, len(at), 256):
        part = at[a : a + 256]
        counts = gram_counts([texts[i] for i in part], m.params)
        cosine = vectors(counts, m.idf) @ m.centroids.T
        best = cosine.argmax(1)
        for row, i, b, k in zip(cosine, part, best, lengths(counts), strict=True):
            names[i], scores[i], rejected[i] = m.langs[b], float(min(1, max(0, row[b]))), bool(row[b] < m.least[b, k])
    return names, scores, rejected


def predict(spark: SparkSession, docs: DataFrame, model: Model, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the named extra columns, lang_pred, score, rejected for every row of ``docs``."""
    shared = spark.sparkContext.broadcast(model)  # centroids times 2**bits floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            names, scores, rejected = score_texts(list(x.pop("text")), shared.value)
            yield x.assign(lang_pred=names, score=scores, rejected=rejected)

    rows = docs.select("doc_id", *extra, "text")
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.drop("text").dtypes)
    return rows.mapInPandas(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def identify(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    model = fit(docs.where(fold() != 1), params)
    marked = docs.select("doc_id", "text", (fold() == 1).alias("held_out"))
    return predict(spark, marked, model, ("held_out",))


def keep_known(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents whose language is not rejected, with all their columns.

    The text is scored where it lies: one pass, no shuffle.
    """
    shared = spark.sparkContext.broadcast(fit(docs.where(fold() != 1), params))

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        return ~pd.Series(score_texts(list(text), shared.value)[2], dtype=bool)

    return docs.where(known("text"))


__all__ = ["Model", "Params", "fit", "gram_counts", "identify", "keep_known", "predict", "score_texts"]

"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

A document is described by statistics of its characters, words and lines. Standardised, they go
through random Fourier features, which approximate a Gaussian kernel. Ridge scores come from the
normal equations, which each partition sums over its labelled rows and which are then added row
of the matrix by row of the matrix. Isotonic regression over binned scores of labelled rows that
took no part in the fit turns scores into probabilities.

Learning rows are the labelled ones whose fold is not 1: fold 0 fits the ridge, fold 2 the
calibration. All labelled rows of those folds take part. Labels, lang, source and doc_id are
never inputs of a score.

Defined results: null texts are scored as empty ones. With no learning rows every score is 0.5.
Rows with a null quality are not learned from; a doc_id with several labels counts once for each.
Repeated rows score alike; ties at 0.5 are predicted 1. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold, pieces
from .kernels import mix, span_hashes, windows, words

NAMES = (
    "log_words", "word_length", "different_words", "top_word", "same_as_last", "upper", "digit", "symbol", "mark", "bar",
    "stop", "letter", "lines", "line_words", "repeated_lines", "repeated_triples", "no_letter_words", "upper_words",
)


@dataclass(frozen=True)
class Params:
    features: int = 192  #: random Fourier features
    width: float = 4.0  #: of the Gaussian kernel, in standard deviations
    ridge: float = 1.0
    bins: int = 1000  #: of scores, for the calibration
    seed: int = 5


def describe(texts: list[str]) -> np.ndarray:
    """The statistics of each text of a block, a row each."""
    w, rows = words(texts), len(texts)
    doc, size, n = w.doc, w.end - w.start, np.diff(w.first)
    add = lambda at, x=None: np.bincount(at, x, rows)
    chars, place = w.chars[: w.begin[-1]], np.repeat(np.arange(rows), np.diff(w.begin))
    letters = np.maximum(add(doc, size), 1)
    part = lambda mask: add(place[mask]) / letters
    lower = (chars >= 97) & (chars <= 122) | (chars >= 0xDF) & (chars != 0xF7)
    upper = (chars >= 65) & (chars <= 90) | (chars >= 0xC0) & (chars < 0xDF) & (chars != 0xD7)
    count = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    n_low, n_up = count(lower), count(upper)
    ups, lows = n_up[w.end] - n_up[w.start], n_low[w.end] - n_low[w.start]
    many = np.maximum(n, 1)
    key = mix(w.hash + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    top = np.zeros(rows)
    np.maximum.at(top, doc[first], times)
    same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])) if len(w.hash) else np.zeros(0, int)
    h, at = windows(w.hash, doc, 3)
    _, tfirst = np.unique(mix(h + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    end = np.sort(np.concatenate([np.flatnonzero(chars == 10), w.begin[1:] - 1]))
    start = np.concatenate([[0], end[:-1] + 1])
    line = np.searchsorted(w.begin, start, "right") - 1
    lines = np.maximum(add(line), 1)
    _, lfirst = np.unique(mix(span_hashes(w.chars, start, end) + line.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    return np.column_stack([
        np.log1p(n), np.minimum(letters / many, 30), add(doc[first]) / many, top / many, add(doc[same]) / many,
        part(upper), part((chars >= 48) & (chars <= 57)), part(np.isin(chars, [ord(c) for c in "#*$%&<>"])),
        part(np.isin(chars, [ord(c) for c in "!?"])), part(chars == ord("|")), part(np.isin(chars, [ord(c) for c in ".,;:"])),
        part(lower | upper), np.log(lines), np.log1p(n / lines), 1 - add(line[lfirst]) / lines, 1 - add(doc[at][tfirst]) / np.maximum(add(doc[at]), 1),
        add(doc[(ups + lows) == 0]) / many, add(doc[(ups > 1) & (lows == 0)]) / many,
    ])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    shift: np.ndarray
    beta: np.ndarray
    raw: np.ndarray  #: knots of the calibration
    score: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.weight + self.shift) * np.sqrt(2 / len(self.shift)), np.ones(len(x))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(x), self.raw, self.score) if len(self.raw) else np.full(len(x), 0.5)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x (array of the statistics) of every row; one pass, nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            x = [describe(texts[a:z]) for a, z in pieces(texts)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": list(np.vstack(x)) if x else []})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, x array<double>")


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of y, x being in order."""
    pools: list[list[float]] = []
    for value, n in zip(y, weight, strict=True):
        pools.append([value, n, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, m, k = pools.pop()
            u, l, j = pools[-1]
            pools[-1] = [(u * l + v * m) / (l + m), l + m, j + k]
    return np.repeat([v for v, _, _ in pools], [int(k) for _, _, k in pools])


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Learn from the rows of ``stats`` that have a label (doc_id, quality) and are not held out."""
    d, rng = len(NAMES), np.random.default_rng(params.seed)
    weight = rng.normal(0, 1 / params.width, (d, params.features))
    shift = rng.uniform(0, 2 * np.pi, params.features)
    scratch = Scratch(spark, "quality")
    own = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    known = scratch.keep(stats.join(own.where(fold() != 1), "doc_id").select(fold().alias("fold"), "x", "y"), "known")
    each = known.where("fold = 0").select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, scale = np.zeros(d), np.ones(d)
    for r in each:
        mean[r["i"]], scale[r["i"]] = r["m"], max(r["s"], 1e-6)
    model = Model(mean, scale, weight, shift, np.zeros(params.features + 1), np.zeros(0), np.zeros(0))
    if not each:
        return model

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((params.features + 1, params.features + 2))
        for b in batches:
            for a in range(0, len(b), 4096):
                part = b.iloc[a : a + 4096]
                z = model.fourier(np.vstack(part["x"].to_list()))
                total += z.T @ np.column_stack([z, part["y"].to_numpy()])
        yield pd.DataFrame({"i": range(len(total)), "row": list(total)})

    def added(b: pd.DataFrame) -> pd.DataFrame:  # one row for each partition
        return pd.DataFrame({"i": b["i"].iloc[:1], "row": [np.sum(b["row"].to_list(), axis=0)]})

    parts = known.where("fold = 0").select("x", "y").mapInPandas(sums, "i int, row array<double>")
    rows = sorted(parts.groupBy("i").applyInPandas(added, "i int, row array<double>").collect())
    both = np.array([r["row"] for r in rows])
    beta = np.linalg.solve(both[:, :-1] + params.ridge * np.eye(len(both)), both[:, -1])
    model = Model(mean, scale, weight, shift, beta, np.zeros(0), np.zeros(0))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                raw = np.clip(model.ridge(np.vstack(b["x"].to_list())), -0.5, 1.5)
                yield pd.DataFrame({"bin": ((raw + 0.5) / 2 * (params.bins - 1)).round().astype(int), "y": b["y"]})

    bins = known.where("fold = 2").select("x", "y").mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).toPandas().sort_values("bin")
    scratch.close()
    if not len(bins):
        return Model(mean, scale, weight, shift, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    x = bins["bin"].to_numpy() / (params.bins - 1) * 2 - 0.5
    return Model(mean, scale, weight, shift, beta, x, isotonic(x, bins["y"].to_numpy(), bins["n"].to_numpy()))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scratch = Scratch(spark, "statistics")
    stats = scratch.keep(statistics(docs), "statistics")
    shared = spark.sparkContext.broadcast(fit(spark, stats, labels, params))  # of the size of the features

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = shared.value(np.vstack(b.pop("x").to_list())) if len(b) else np.zeros(0)
            yield b.drop(columns="x", errors="ignore").assign(score=np.clip(score, 0, 1), predicted=(score >= 0.5).astype(np.int32))

    return stats.select("doc_id", (fold() == 1).alias("held_out"), "x").mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")

"""Quality rules: repetition coverage.

Hashes of windows of words come from rolling polynomials in numpy, for several window lengths; a
window is a duplicate if it is found twice or more in its text. Coverage is the part of a text's
word characters that lie inside duplicate windows of one length, and the part of its line
characters that lie inside duplicate lines. A text fails if any coverage is above its limit. A
window of n + 1 words can only be a duplicate where one of n words is, so longer windows are
hashed only there.

Words are runs of characters other than space and U+0009 to U+000D, lines are what \\n parts.

Defined results: null, empty and blank texts have no word; all counts are 0 and the base rule
(fewer than ``least_words``) fails them. Texts of any length are judged whole. Repeated rows are
judged alike. Empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import pieces
from .kernels import mix, span_hashes, windows, words

SYMBOLS = "#*$%&|<>"  #: fixed values


@dataclass(frozen=True)
class Params:
    base_window: int = 8
    base_percent: int = 30  #: of words in duplicate base windows
    least_words: int = 20
    #: Limits of the covered part of the characters, by window length.
    limits: dict[int, float] = field(default_factory=lambda: {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30})
    line_limit: float = 0.30


def _repeated(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which hashes are found twice or more in their row."""
    _, back, count = np.unique(mix(hashes + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
    return count[back] > 1


def measure(texts: list[str], p: Params) -> dict[str, np.ndarray]:
    """Counts and coverages of each text of a block."""
    w, rows = words(texts), len(texts)
    add = lambda doc, x=None: np.bincount(doc, x, rows)
    size = w.end - w.start
    out = {"n_words": np.diff(w.first), "word_chars": add(w.doc, size).astype(np.int64)}
    place = np.repeat(np.arange(rows), np.diff(w.begin))
    symbol = np.isin(w.chars[: w.begin[-1]], [ord(c) for c in SYMBOLS])
    out["n_symbols"] = add(place[symbol])

    end = np.sort(np.concatenate([np.flatnonzero(w.chars[: w.begin[-1]] == 10), w.begin[1:] - 1]))
    start = np.concatenate([[0], end[:-1] + 1])
    seen = np.searchsorted(w.start, start) < np.searchsorted(w.start, end)  # a word starts in it
    start, end = start[seen], end[seen]
    doc = np.searchsorted(w.begin, start, "right") - 1
    _, first, back, count = np.unique(mix(span_hashes(w.chars, start, end) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(start), bool)
    later[first] = False
    out["n_dup_lines"] = add(doc[later])
    twice = count[back] > 1
    out["line_coverage"] = add(doc[twice], (end - start)[twice]) / np.maximum(add(doc, end - start), 1)

    at = np.arange(len(w.hash))
    for n in sorted({*p.limits, p.base_window}):
        if n == min({*p.limits, p.base_window}):
            h, at = windows(w.hash, w.doc, n)
        else:  # only where a shorter window is a duplicate
            at = at[(at + n <= len(w.hash))]
            at = at[w.doc[at] == w.doc[at + n - 1]]
            h = np.zeros(len(at), np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + i]
            h = mix(h)
        at = at[_repeated(h, w.doc[at])]
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        inside = np.cumsum(edge[:-1]) > 0
        out[f"coverage_{n}"] = add(w.doc[inside], size[inside]) / np.maximum(out["word_chars"], 1)
        if n == p.base_window:
            out["n_repeat_words"] = add(w.doc[inside])
    return out


def judge(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, the counts, the coverages, base_failed and kept of every row, in one pass."""
    lengths = sorted({*params.limits, params.base_window})
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    parts = ["line_coverage", *(f"coverage_{n}" for n in lengths)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts = [t or "" for t in x["text"]]
            for a, b in pieces(texts):
                m = measure(texts[a:b], params)
                failed = (m["n_words"] < params.least_words) | (100 * m["n_repeat_words"] > params.base_percent * m["n_words"])
                over = m["line_coverage"] > params.line_limit
                for n, limit in params.limits.items():
                    over |= m[f"coverage_{n}"] > limit
                yield pd.DataFrame({"doc_id": x["doc_id"].iloc[a:b].to_numpy()} | {k: m[k].astype(np.int64) for k in counts} | {k: m[k] for k in parts} | {"base_failed": failed, "kept": ~failed & ~over})

    kinds = ["doc_id long", *(f"{k} long" for k in counts), *(f"{k} double" for k in parts), "base_failed boolean", "kept boolean"]
    return docs.select("doc_id", "text").mapInPandas(run, ", ".join(kinds))

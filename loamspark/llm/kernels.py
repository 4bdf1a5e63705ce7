"""Numpy kernels over blocks of texts: words, their hashes and windows of words.

A block is a list of texts joined by one space into one array of code points, so that the
cost of a numpy call is shared by many short texts.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


class Words(NamedTuple):
    chars: np.ndarray  #: code points of the block
    start: np.ndarray  #: of each word
    end: np.ndarray  #: exclusive
    hash: np.ndarray  #: uint64
    doc: np.ndarray  #: row of each word in the block
    first: np.ndarray  #: number of the first word of each row, and the number of words at the end
    begin: np.ndarray  #: where each row's text starts


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_hashes(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of characters from one rolling polynomial, whatever their place."""
    up, down = powers(len(chars) + 1)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(texts: list[str]) -> Words:
    """Words are runs of characters other than space and U+0009 to U+000D."""
    chars = code_points(" ".join(texts) + " ")
    blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(start, begin)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(chars, start, end, span_hashes(chars, start, end), doc, first, begin)


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of n words that lies in one row, and the number of its first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        h = h * BASE + hashes[i : len(hashes) - n + 1 + i]
    at = np.flatnonzero(doc[: len(h)] == doc[n - 1 :])
    return mix(h[at]), at

"""Arrow arrays of a block's words, and crc32 of many strings at once."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Words are runs of 0-9, a-z and all bytes of characters from U+0080 on, once A-Z are in lower case.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACE = 32


class Words(NamedTuple):
    words: pa.Array  #: binary, all words of a block in order
    first: np.ndarray  #: number of the first word of each text, and the number of words


def words_of(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    data = (b" ".join(raw) + b" ").translate(_LETTERS)
    blank = np.frombuffer(data, np.uint8) == _SPACE
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    first = np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in raw]))
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.translate(None, b" "))])
    return Words(words, first)


def places(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings of an array (and the end) in its bytes."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return offsets, np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.zeros(0, np.uint8)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = table >> 1 ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()


def crc32(values: pa.Array) -> np.ndarray:
    """crc32 of each string, byte by byte over all strings at once; the last few long ones singly."""
    offsets, data = places(values)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, state, longer = offsets[:-1][order], np.full(len(size), 0xFFFFFFFF, np.uint32), np.cumsum(np.bincount(size)[::-1])[::-1]
    done = 0
    for k in range(int(size.max(initial=0))):
        m = int(longer[k + 1])
        if m < 32:
            done = m
            break
        state[:m] = _CRC[(state[:m] ^ data[start[:m] + k]) & 0xFF] ^ state[:m] >> 8
    out = np.empty(len(size), np.uint32)
    out[order] = ~state
    for i in order[:done].tolist():
        out[i] = zlib.crc32(data[offsets[i] : offsets[i + 1]])
    return out

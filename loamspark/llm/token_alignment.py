"""Cross-tokenizer alignment: where the tokens of two public tokenizers end together.

Both tokenizers encode a space and the text. Token bytes come from the vocabularies, so every
token has a byte range. Packed bitsets mark the bytes where tokens of A and of B end; their AND
holds the shared cuts, and ranks by popcount map each cut to the numbers of the tokens before it.
Tokens between two cuts form a group. The links are the pairs of an A and a B token whose ranges
end at one byte: as no token is empty, each cut has one link, between the last tokens of its group.

Neither tokenizer joins anything across a space that follows a character other than white space:
the pattern of A starts a new piece there, and no piece of B has a space after another character.
So a text falls into parts at such spaces, the parts of a block of texts are numbered, and each
different part is encoded and cut once. The links of each text are kept, in four bytes each (so ids
must be below 65,536), until the counts of id pairs are summed over all texts.

Two ends at one byte mean that the bytes of one token end with those of the other. So there are at
most as many id pairs as the tokens of both vocabularies have non-empty endings (under a million),
whatever the corpus: this bounds the counts that are broadcast.

Defined results: texts that are null or empty, or that either tokenizer doesn't give back byte by
byte, have no tokens: counts are zero and groups are empty. Null and repeated doc_ids keep their
rows. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

#: The pattern that splits a text before the merges of A's vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Params:
    a: str = "/opt/tokenizers/byte_bpe_50k.json"  #: byte-level BPE
    b: str = "/opt/tokenizers/piece_bpe_32k.model"  #: BPE with byte fallback, adds the leading space
    block: int = 1_000_000  #: characters of a block of texts, about
    chunk: int = 16_384  #: characters that are encoded in one call


class Tokenizer(NamedTuple):
    encode: object  #: text (without the leading space) to a list of ids
    token: list[bytes]
    size: np.ndarray  #: bytes of each token


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> Tokenizer:
    import tiktoken

    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    special, letter = {t["content"] for t in found["added_tokens"]}, byte_letters()
    token = [b""] * (max([*found["model"]["vocab"].values(), *(t["id"] for t in found["added_tokens"])]) + 1)
    for text, i in found["model"]["vocab"].items():
        if text not in special:
            token[i] = bytes(letter[c] for c in text)
    if len(token) > 1 << 16:
        raise ValueError("a vocabulary of more than 65,536 tokens")
    ranks = {t: i for i, t in enumerate(token) if t}
    own = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer(lambda text: own.encode_ordinary(" " + text), token, np.array([len(t) for t in token]))


@lru_cache(maxsize=2)
def piece_bpe(path: str) -> Tokenizer:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    n, token = own.get_piece_size(), []
    for i in range(n):
        piece = own.id_to_piece(i)
        if own.is_byte(i):
            token.append(bytes([int(piece[3:-1], 16)]))
        else:
            token.append(piece.replace("▁", " ").encode())
    if n > 1 << 16:
        raise ValueError("a vocabulary of more than 65,536 tokens")
    if any(re.search("[^▁]▁", own.id_to_piece(i)) for i in range(n)):
        raise ValueError("a piece of the model goes on after a space: texts can't be cut there")
    return Tokenizer(lambda text: own.encode(text, num_threads=1), token, np.array([len(t) for t in token]))


# --- parts of texts ----------------------------------------------------------------------


def parts_of(text: str) -> list[str]:
    """The parts of a text; a space stands before each."""
    if text[0] != " " and text[-1] != " " and not re.search(r"\s ", text):
        return text.split(" ")
    return re.split(r"(?<=\S) (?!\Z)", text)


class Cut(NamedTuple):
    """Parts in a row, encoded by both tokenizers and cut where tokens of both end."""

    a: np.ndarray  #: ids
    b: np.ndarray
    first_a: np.ndarray  #: number of the first token of each group, and the number of tokens
    first_b: np.ndarray
    first: np.ndarray  #: number of the first group of each part, and the number of groups
    good: np.ndarray  #: whether both tokenizers give each part back; the others have no tokens
    cut: np.ndarray  #: byte after each group


def _encoded(texts: list[str], p: Params) -> tuple[list[list[int]], list[list[int]], list[bool]]:
    """Ids of the texts, in runs, and whether each text comes back."""
    a, b, good = byte_bpe(p.a), piece_bpe(p.b), []
    ids: tuple[list[list[int]], list[list[int]]] = ([], [])
    runs, room = [], 0
    for t in texts:  # a part at whose end white space stands would join with the next
        if runs and room + len(t) < p.chunk and not runs[-1][-1][-1].isspace():
            runs[-1].append(t)
            room += len(t) + 1
        else:
            runs.append([t])
            room = len(t)
    while runs:
        run = runs.pop(0) if len(runs) < 2 else runs.pop()
        joined = " ".join(run)
        one, two, want = a.encode(joined), b.encode(joined), b" " + joined.encode()
        same = b"".join(map(a.token.__getitem__, one)) == want and b"".join(map(b.token.__getitem__, two)) == want
        if same or len(run) == 1:
            ids[0].append(one if same else [])
            ids[1].append(two if same else [])
            good.append((run, same))
        else:
            runs += [run[len(run) // 2 :], run[: len(run) // 2]]
    return ids[0], ids[1], good


def rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits of packed 64-bit words up to and with each place."""
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
    return before[word] + np.bitwise_count(bits[word] & mask)


def packed(at: np.ndarray, size: int) -> np.ndarray:
    """A bitset of 64-bit words with the places ``at`` set."""
    flags = np.zeros((size + 63) // 64 * 64, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def cut_parts(parts: list[str], p: Params) -> tuple[Cut, list[str]]:
    """The parts, in the order in which they were encoded, and their cuts."""
    a, b = byte_bpe(p.a), piece_bpe(p.b)
    ids_a, ids_b, good = _encoded(parts, p)
    parts = [t for run, _ in good for t in run]
    fine = np.array([same for run, same in good for _ in run], bool)
    one, two = (np.array([i for run in ids for i in run], np.int64) for ids in (ids_a, ids_b))
    size = np.array([len(t.encode()) + 1 for t in parts], np.int64) * fine
    total = int(size.sum())
    both_a, both_b = packed(np.cumsum(a.size[one]) - 1, total), packed(np.cumsum(b.size[two]) - 1, total)
    shared = both_a & both_b
    at = np.flatnonzero(np.unpackbits(shared.view(np.uint8), bitorder="little"))
    ends = np.cumsum(size) - 1
    if not np.isin(ends[fine], at).all():
        raise ValueError("a token goes on after the end of a part")
    first = np.concatenate(([0], np.where(ends >= 0, rank(shared, np.maximum(ends, 0)), 0) if total else np.zeros(len(parts), np.int64)))
    first_a, first_b = (np.concatenate(([0], rank(bits, at))) for bits in (both_a, both_b))
    return Cut(one, two, first_a, first_b, first, fine, at + 1), parts


def as_text(cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """ASCII bytes of the groups (a1,a2|b1; for each) and the place of each group's first byte, and the end."""
    n_a, n_b = np.diff(cut.first_a), np.diff(cut.first_b)
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    place_a = np.arange(len(cut.a)) + cut.first_b[group_a]
    place_b = np.arange(len(cut.b)) + cut.first_a[group_b + 1]
    ids, mark = np.zeros(len(cut.a) + len(cut.b), np.int64), np.full(len(cut.a) + len(cut.b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = cut.a, cut.b
    mark[place_a[cut.first_a[1:] - 1]], mark[place_b[cut.first_b[1:] - 1]] = ord("|"), ord(";")
    width = len(str(int(ids.max(initial=0))))
    rest = ids[:, None] // 10 ** np.arange(width - 1, -1, -1)
    text = np.column_stack([(rest % 10 + 48).astype(np.uint8), mark])
    keep = np.column_stack([rest > 0, np.ones(len(ids), bool)])
    keep[:, width - 1] = True  # an id of zero has a digit too
    length = np.concatenate(([0], np.cumsum(keep.sum(1))))
    return text[keep], length[cut.first_a + cut.first_b]


# --- blocks of texts ---------------------------------------------------------------------

KEPT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("digest", pa.string()), ("links", pa.binary())])


class Numbered(NamedTuple):
    cut: Cut
    first: np.ndarray  #: of each text's parts in ``parts``
    parts: np.ndarray  #: numbers of the parts of the texts


def number(texts: list[str], p: Params) -> Numbered:
    """The parts of a block of texts, each different one cut once; texts that don't come back have none."""
    seen: dict[str, int] = {}
    own = [[seen.setdefault(x, len(seen)) for x in parts_of(t)] if t else [] for t in texts]
    cut, order = cut_parts(list(seen), p)
    moved = np.zeros(len(seen), np.int64)
    moved[[seen[x] for x in order]] = np.arange(len(seen))
    first = np.cumsum([0] + [len(x) for x in own])
    parts = moved[np.array([i for x in own for i in x], np.int64)]
    bad = np.zeros(len(texts), bool)
    bad[np.repeat(np.arange(len(texts)), np.diff(first))[~cut.good[parts]]] = True
    if bad.any():
        parts = parts[~np.repeat(bad, np.diff(first))]
        first = np.concatenate(([0], np.cumsum(np.where(bad, 0, np.diff(first)))))
    return Numbered(cut, first, parts)


def _sums(each: np.ndarray, n: Numbered) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(each[n.parts])))
    return np.diff(total[n.first])


def encode_block(doc_ids: list[int | None], texts: list[str], p: Params) -> pa.RecordBatch:
    n = number(texts, p)
    cut = n.cut
    text, at = as_text(cut)
    raw, at = text.tobytes(), at[cut.first]
    strings = [raw[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    numbers, digests = n.parts.tolist(), []
    for a, z in zip(n.first[:-1].tolist(), n.first[1:].tolist(), strict=True):
        own = b"".join([strings[i] for i in numbers[a:z]])
        digests.append(hashlib.sha256(own[:-1]).hexdigest() if own else "")
    counts = [_sums(np.diff(x), n) for x in (cut.first_a[cut.first], cut.first_b[cut.first], cut.first)]
    link = (cut.a[cut.first_a[1:] - 1] << 16 | cut.b[cut.first_b[1:] - 1]).astype(np.uint32)
    size = np.diff(cut.first)[n.parts]
    links = link[np.repeat(cut.first[n.parts] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    edges = np.concatenate(([0], np.cumsum(counts[2]))) * links.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(links.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *map(pa.array, counts), pa.array(digests), data], schema=KEPT)


def encoded(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, digest and links (packed pairs of ids) of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for ids, texts in slices(x, p.block):
                yield encode_block(ids, texts, p)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, digest string, links binary")


def _links(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed pairs of all rows, and the place of each row's first and the end."""
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    data = np.frombuffer(x.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data.view(np.uint32), (offsets - offsets[0]) // 4


def pair_counts(kept: DataFrame) -> DataFrame:
    """pair (the ids of a and b in 16 bits each) and n, the number of links, of every linked pair of ids."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            pair, n = np.unique(_links(x.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    return kept.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(spark: SparkSession, docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(spark, "alignment")
    kept = scratch.keep(encoded(docs, p), "encoded")
    counts = pair_counts(kept).toPandas().sort_values("pair")  # bounded by the two vocabularies
    pair, n = counts["pair"].to_numpy(np.uint32), counts["n"].to_numpy(np.int64)
    best = np.zeros(1 << 16, np.int64)
    np.maximum.at(best, pair & 0xFFFF, n)
    shared = spark.sparkContext.broadcast((pair, n, n == best[pair & 0xFFFF]))
    schema = pa.schema([*list(KEPT)[:4], ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for x in batches:
            links, first = _links(x.column("links"))
            at = np.searchsorted(pair, links)
            sums = [np.diff(np.concatenate(([0], np.cumsum(v[at], dtype=np.int64)))[first]) for v in (best, n)]
            yield pa.RecordBatch.from_arrays([*x.columns[:4], pa.array(np.diff(first)), *map(pa.array, sums), x.column("digest")], schema=schema)

    return kept.mapInArrow(run, ", ".join(f"{x} long" for x in schema.names[:-1]) + ", groups_sha256 string")


def groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, start and end (bytes of the space and the text), a and b (ids) of every group of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for ids, texts in slices(x, p.block):
                n, out = number(texts, p), []
                cut, begin = n.cut, np.concatenate(([0], n.cut.cut))
                for i in range(len(texts)):
                    at = 0
                    for k in n.parts[n.first[i] : n.first[i + 1]].tolist():
                        for g in range(cut.first[k], cut.first[k + 1]):
                            size = int(begin[g + 1] - begin[g])
                            out.append((ids[i], at, at + size, cut.a[cut.first_a[g] : cut.first_a[g + 1]].tolist(), cut.b[cut.first_b[g] : cut.first_b[g + 1]].tolist()))
                            at += size
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, end long, a array<int>, b array<int>")

"""URL filters: rules, and a Bloom filter cascade over the corpus's complete key universe.

The keys of a url are its host and all parent domains of it. A cascade holds which keys are
listed: level 0 is a Bloom filter of the listed keys of the universe, level 1 one of the unlisted
keys of the universe that level 0 lets through, level 2 one of the listed keys that level 1 lets
through, and so on until nothing is let through wrongly. The universe being all keys of the
corpus, the answer is exact for every url of it, and judging a url needs no join.

Filters are built from the keys as DataFrames; only their bits reach the driver and the tasks.
Up to ``broadcast`` bytes of bits are broadcast; a list that would need more is matched by a
shuffle join of the distinct keys instead.

Rules come first: a rule fits its host and all subdomains of it if the url's path starts with the
rule's path; the longest rule wins.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed. Null and empty keys list nothing. Repeated rows are judged alike. Urls are read whole. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rule (host and path) and its verdict.
RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}

#: Domains that are blocked, with all subdomains, where no rule fits.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


@dataclass(frozen=True)
class Params:
    error: float = 0.01  #: share of false positives of a level
    broadcast: int = 32_000_000  #: bytes of filters that are broadcast at most


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  #: uint64 words
    hashes: int
    seed: int

    def places(self, keys: Iterable[str]) -> np.ndarray:
        """Bit numbers of each key, a row each."""
        own = np.array([(xxhash.xxh3_64_intdigest(k, self.seed), xxhash.xxh3_64_intdigest(k, self.seed + 1)) for k in keys], np.uint64).reshape(-1, 2)
        steps = np.arange(self.hashes, dtype=np.uint64)
        return (own[:, :1] + (own[:, 1:] | np.uint64(1)) * steps) % np.uint64(64 * len(self.bits))

    def holds(self, keys: Iterable[str]) -> np.ndarray:
        at = self.places(keys)
        return ((self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def keys_of(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _level(keys: DataFrame, n: int, number: int, p: Params) -> Level:
    """A Bloom filter of the n keys: each task sets bits, equal words are or-ed together."""
    size = max(1, math.ceil(n * -math.log(p.error) / math.log(2) ** 2 / 64))
    level = Level(np.zeros(size, np.uint64), max(1, round(-math.log2(p.error))), 2 * number + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros(size, np.uint64)
        for b in batches:
            at = level.places(b["key"]).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        own = np.flatnonzero(words)
        yield pd.DataFrame({"word": own, "bits": words[own].view(np.int64)})

    found = keys.mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    level.bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return level


def _let_through(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[level.holds(b["key"])] if len(b) else b

    return keys.mapInPandas(run, "key string")


def cascade(spark: SparkSession, universe: DataFrame, listed: DataFrame, params: Params = Params()) -> list[Level] | None:
    """The levels for the listed keys among the universe (both: distinct key), None if too large."""
    scratch = Scratch(spark, "cascade")
    inside = scratch.keep(universe.join(listed, "key", "left_semi"), "keys")
    outside = scratch.keep(universe.join(listed, "key", "left_anti"), "keys")
    levels: list[Level] = []
    while n := inside.count():
        if sum(x.bits.nbytes for x in levels) + n * -math.log(params.error) / math.log(2) ** 2 / 8 > params.broadcast:
            return None
        levels.append(_level(inside, n, len(levels), params))
        inside, outside = scratch.keep(_let_through(outside, levels[-1]), "keys"), inside
    scratch.close()
    return levels


def member(keys: list[str], levels: list[Level]) -> np.ndarray:
    """Which keys of the universe are listed: the first level that a key fails decides."""
    out, left = np.zeros(len(keys), bool), np.arange(len(keys))
    for i, level in enumerate(levels):
        if not len(left):
            break
        passed = level.holds([keys[k] for k in left])
        out[left[~passed]] = i % 2 == 1
        left = left[passed]
    out[left] = len(levels) % 2 == 1
    return out


def judge(spark: SparkSession, pages: DataFrame, listed: DataFrame, rules: dict[str, str] | None = None, params: Params = Params()) -> DataFrame:
    """page_id, host, path, rule and verdict of every row; ``listed`` holds the blocked domains (key)."""
    rules = RULES if rules is None else rules
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = rows.select("host").distinct()
    universe = hosts.select(F.explode(keys_of(F.col("host"))).alias("key")).distinct()
    listed = listed.select("key").where("key <> ''").distinct()
    levels = cascade(spark, universe, listed, params)
    if levels is None:  # beyond what may be broadcast
        bad = hosts.select("host", F.explode(keys_of(F.col("host"))).alias("key")).join(listed, "key", "left_semi").select("host").distinct()
        rows = rows.join(bad.withColumn("in_list", F.lit(True)), "host", "left").withColumn("in_list", F.coalesce("in_list", F.lit(False)))
    else:
        shared = spark.sparkContext.broadcast(levels)

        @F.pandas_udf(T.BooleanType())
        def in_list(host: pd.Series) -> pd.Series:
            code, names = pd.factorize(host)
            keys = [".".join(h.split(".")[i:]) for h in names for i in range(h.count(".") + 1)]
            hit = member(keys, shared.value)
            bad = np.array([x.any() for x in np.split(hit, np.cumsum([h.count(".") + 1 for h in names])[:-1])], bool)
            return pd.Series(bad[code] if len(names) else np.zeros(len(host), bool))

        rows = rows.withColumn("in_list", in_list("host"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv)) if rules else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("rule", rule)
    return rows.select("page_id", "host", "path", "rule", F.coalesce(F.element_at(verdict, F.col("rule")), F.when(F.col("in_list"), "block").otherwise("allow")).alias("verdict"))

"""Secret scans: base patterns, and Markov models of random strings and ordinary identifiers.

Everything is DataFrame expressions; there is no Python code on the executors.

Base patterns find assignments (password=..., token: "..."), access keys (AKIA...) and long hex
runs. The method adds candidate runs of 16 or more token characters that overlap no base span:
each is scored by two first-order character Markov models, one trained on random strings and one
on ordinary identifiers, and is a secret if the log-likelihood ratio passes ``threshold``.

Training samples are labelled rows. By default the random ones are the values that the base
patterns found in the corpus and ``synthetic`` digests in base64, hex and base32-like letters;
the ordinary ones are all candidate runs without a digit outside base spans and ``synthetic``
decimal numbers (order, card and phone numbers are no secrets). Transition counts are
taken over all of them; only the table of counts, at most the square of the alphabet, reaches
the driver.

Places are in code points, ends exclusive. They follow from the lengths of what lies between
matches: ``split`` and ``regexp_extract_all`` scan a text in the same way.

Defined results: a null text counts as empty and has no spans; its digest is that of the empty
string. Repeated rows are scanned alike. Texts are read whole, whatever their length. An empty
table gives an empty result, and extra columns are ignored (or kept, by ``redact``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: The base patterns with the group that is measured and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

RUN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1  #: state 0 stands for the start and any other character
FOUND = "array<struct<start:int,end:int,text:string>>"
SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Params:
    threshold: float = 9.0  #: log-likelihood ratio of a secret, about ln(8000) for the prior odds
    synthetic: int = 4000  #: digests of each of three alphabets, and decimal numbers, added to the samples
    smooth: float = 0.5  #: added to every transition count


def _found(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern whose group has ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))
    none = F.array().cast(FOUND)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["whole"].alias("text")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(SPANS)


def base_spans(text: Column) -> Column:
    """Base spans of a (non-null) text by start, then kind."""
    own = (_found(text, ASSIGN, 2, 6), _found(text, ACCESS), _found(text, HEX))
    return F.array_sort(F.concat(*(_spans(x, kind) for kind, x in enumerate(own))))


def free_runs(text: Column, spans: Column) -> Column:
    """Candidate runs that overlap no base span."""
    return F.filter(_found(text, RUN), lambda r: ~F.exists(spans, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))


def as_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def transitions(run: Column) -> Column:
    """Numbers of the transitions between the characters of a run, the first from the start state."""
    states = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(states, F.lit(1), F.size(states) - 1)), states, lambda a, b: a * SIZE + b)


def fit(samples: DataFrame, params: Params = Params()) -> list[float]:
    """Log-likelihood ratio of each transition, from samples (run string, random boolean)."""
    steps = samples.where("run <> ''").select("random", F.explode(transitions(F.col("run"))).alias("step"))
    counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}

    def logs(random: bool) -> list[float]:
        n = [[counts.get((random, a * SIZE + b), 0) + params.smooth for b in range(SIZE)] for a in range(SIZE)]
        return [math.log(x / sum(row)) for row in n for x in row]

    return [a - b for a, b in zip(logs(True), logs(False), strict=True)]


def ratio(run: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a run: random against ordinary."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    return F.aggregate(transitions(run), F.lit(0.0), lambda acc, t: acc + F.element_at(table, t + 1))


def default_samples(spark: SparkSession, read: DataFrame, params: Params = Params()) -> DataFrame:
    """Labelled runs: from what the base patterns found and left (``values``, ``runs``), and digests."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    made = spark.range(params.synthetic).select(F.explode(F.array(b64, digest, F.upper(b64))).alias("run"), F.lit(True).alias("random"))
    digit = F.col("run").rlike("[0-9]")
    values = read.select(F.explode("values").alias("run")).where(digit & (F.length("run") >= 16)).withColumn("random", F.lit(True))
    ordinary = read.select(F.explode("runs.text").alias("run")).where(~digit).withColumn("random", F.lit(False))
    number = F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**16)).cast("string"), 16, "7")
    numbers = spark.range(params.synthetic).select(number.alias("run"), F.lit(False).alias("random"))
    return made.union(values).union(ordinary).union(numbers)


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, values of the base matches and free candidate runs of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    own = F.transform("base", lambda b: F.substring(F.col("text"), b["start"] + 1, b["end"] - b["start"]))
    values = F.transform(own, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, ASSIGN, 2), F.lit("")), x))
    return rows.select("doc_id", "base", values.alias("values"), free_runs(F.col("text"), F.col("base")).alias("runs"))


def _all_spans(base: Column, runs: Column, model: list[float], params: Params) -> Column:
    secret = F.filter(runs, lambda r: ratio(r["text"], model) >= params.threshold)
    return F.array_sort(F.concat(base, _spans(secret, 3)))


def scan(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, base (array of base spans) and spans (array of all spans) of every row."""
    scratch = Scratch(spark, "secrets")
    read = scratch.keep(_read(docs), "read")
    model = fit(default_samples(spark, read, params), params)
    return read.select("doc_id", "base", _all_spans(F.col("base"), F.col("runs"), model, params).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, params: Params = Params(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark, and n_chars (if there) made to fit."""
    scratch = Scratch(spark, "secrets")
    model = fit(default_samples(spark, scratch.keep(_read(docs).select("values", "runs"), "read"), params), params)
    scratch.close()
    text = F.col("text")
    rows = docs.withColumn("_base", F.when(text.isNotNull(), base_spans(text)))
    rows = rows.withColumn("_spans", F.when(text.isNotNull(), _all_spans(F.col("_base"), free_runs(text, F.col("_base")), model, params)))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        put = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), put.alias("out"))

    done = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    clean = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    rows = rows.withColumn("text", F.when(F.size("_spans") > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)

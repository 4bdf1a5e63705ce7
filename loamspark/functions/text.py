"""Normalisers, ids, sentences and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it, and the characters a key keeps.
SPACE = r"[\t\n\x{b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: The same for Spark's patterns: one test of a range spares most characters the rest.
SPACES = r"[\t\n\x{b}\f\r \x{a0}[\x{1680}-\x{feff}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]]"
#: Runs of white space but a plain blank alone, which need not be replaced.
RUNS = SPACES + "{2,}|[[^ ]&&" + SPACES + "]"
NOT_KEY = r"[^a-z0-9@.+$%]+"
ARTICLES = r"\b(the|a|an)\b"

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_words(pattern: str, ignore_case: bool = False) -> str:
    r"""A pattern whose \b means a boundary of ASCII words, as in browsers, not of Unicode ones."""
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", _EDGE)


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(ascii_words(pattern, ignore_case))


def clean(text: Column) -> Column:
    """No NUL, runs of white space as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit("")), RUNS, " "))


def key_text(text: Column) -> Column:
    """Lower-cased clean text of key characters only; letters with accents become spaces."""
    low = F.regexp_replace(F.lower(clean(text)), "[’']", "'")
    return F.trim(F.regexp_replace(low, NOT_KEY, " "))


def page_text(text: Column) -> Column:
    """Lower-cased, url queries cut, Unicode punctuation and symbols as spaces."""
    cut = F.regexp_replace(F.lower(clean(text)), r"(https?://[^ ?#]+)[?#][^ ]*", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"[\p{P}\p{S}]+", " "), " {2,}", " "))


def intake_text(text: Column) -> Column:
    """Unified line ends, no trailing blanks, two newlines at most, trimmed."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(unix, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"), r"^[ \n\t]+|[ \n\t]+$", "")


def comparable_text(text: Column) -> Column:
    """N4, comparable form: lower-cased, keeps ``$%./:-`` beside letters and digits."""
    return F.trim(F.regexp_replace(F.lower(clean(text)), r"[^a-z0-9$%./:-]+", " "))


def merge_value(text: Column) -> Column:
    """One space between words, trimmed, lower-cased."""
    return F.lower(clean(text))


def conflict_key(text: Column) -> Column:
    """Lower-cased letters and digits without articles and without policy and faq words."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, ascii_words(r"\b(the|a|an|policy|policies|faq|faqs)\b"), " "), " +", " "))


def slug(text: Column) -> Column:
    """The key text without articles, words joined by underscores."""
    return F.regexp_replace(F.trim(F.regexp_replace(key_text(text), ascii_words(ARTICLES), " ")), " +", "_")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the characters as a long; equal to the UTF-16 form for the basic plane."""
    return F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long") % F.lit(4294967296).cast("long"))


def stable_id(prefix: str, text: Column, padded: bool = True) -> Column:
    digits = F.lower(F.hex(F.when(text == "", F.lit(2166136261).cast("long")).otherwise(fnv1a(text))))
    return F.concat(F.lit(prefix + "_"), F.lpad(digits, 8, "0") if padded else digits)


def sha_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.sha2(F.concat_ws("\x00", *(merge_value(p) for p in parts)), 256))


def sentences(text: Column) -> Column:
    """Clean sentences of 12 to 1200 characters: cut after . ! ? before white space, and at newlines."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?<=[.!?]){SPACES}+|\n+", "\x01"), "\x01")
    return F.filter(F.transform(cut, clean), lambda s: F.length(s).between(12, 1200))


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct words of ASCII letters and digits with ``least`` characters, lower-cased, in order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))


def grams(text: Column, most: int) -> Column:
    """Distinct stretches of one to ``most`` characters of a text."""

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(text) - n + 1)
        cuts = F.when(F.length(text) >= n, F.transform(places, lambda i: F.substring(text, i, F.lit(n))))
        return F.coalesce(cuts, F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, range(1, most + 1))))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets: common elements over the smaller size, 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))))


def negated(text: Column) -> Column:
    return matches(F.coalesce(text, F.lit("")), r"\b(?:no|not|never|without|cannot|can't|don't|doesn't|won't|isn't|aren't)\b")


def redact(text: Column) -> Column:
    """Secrets and addresses as a mark: bearer tokens, keyed assignments, e-mail addresses."""
    out = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._~+/-]+=*", "[redacted]")
    out = F.regexp_replace(out, r"(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)[^\s,;]+", "$1$2[redacted]")
    return F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]")


def level(score: Column, high: float = 78, medium: float = 52) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")

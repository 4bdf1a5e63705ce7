"""Url functions as column expressions (http and https urls; no punycode)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EDITORIAL = ("blog", "news", "article", "articles", "press", "insights", "resources", "tag", "category", "author")
ASSETS = (
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "css", "js", "mjs", "json", "xml",
    "zip", "gz", "mp3", "mp4", "webm", "mov", "woff", "woff2", "ttf", "eot",
)


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def bare_host(url: Column) -> Column:
    """Host without port, ``www.`` and a dot at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host(url), ":[0-9]+$", ""), r"^www\.", ""), r"\.$", "")


def path(url: Column) -> Column:
    found = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _trimmed_path(url: Column) -> Column:
    return F.when(path(url) == "/", "/").otherwise(F.regexp_replace(path(url), "/+$", ""))


def canonical(url: Column) -> Column:
    """No fragment, no utm_*, fbclid and gclid, parameters by name, no slash at the end of a path."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(utm_[^=]*|fbclid|gclid)(=|$)"))
    byname = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    tail = F.array_join(F.transform(byname, lambda x: x["p"]), "&")
    return F.when(origin(url) == "", F.trim(url)).otherwise(F.concat(origin(url), _trimmed_path(url), F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def comparable(url: Column) -> Column:
    """No fragment, host in lower case, no slash at the end of a path; the query stays."""
    tail = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")
    return F.when(origin(url) == "", F.lower(F.trim(url))).otherwise(F.concat(origin(url), _trimmed_path(url), tail))


def dedupe(url: Column) -> Column:
    """Neither fragment nor query."""
    return F.concat(origin(url), path(url))


def discoverable(url: Column) -> Column:
    """Not editorial: no editorial segment and no year as first segment; no asset."""
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")
    last = F.element_at(F.split(F.lower(path(url)), r"\."), -1)
    editorial = F.exists(parts, lambda s: s.isin(*EDITORIAL)) | F.coalesce(F.get(parts, F.lit(0)).rlike("^(19|20)[0-9]{2}$"), F.lit(False))
    return ~editorial & ~((F.size(F.split(path(url), r"\.")) > 1) & last.isin(*ASSETS))


def localized(url: Column) -> Column:
    return path(url).rlike("^/(de|fr|es|it|pt|nl|ja|zh)(/|$)")

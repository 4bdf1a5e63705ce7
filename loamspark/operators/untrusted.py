"""Metadata of events made safe (K6), and sitemaps followed through their indexes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import urls as U
from ..session import cut, stored
from ..sources.readers import sitemap

c = F.col

#: Names that private data has, and the bounds of metadata.
UNSAFE = re.compile("content|prompt|token|secret|password|stack|row|payload|knowledge", re.I)
DEPTH, ITEMS, CHARS, BYTES = 3, 20, 256, 4096
REFUSED = "operational_event_metadata_"


class Refusal(ValueError):
    """Metadata that may not be stored; its text is the code."""


def safe(value: object, depth: int = 0) -> object:
    """A JSON value with long texts cut; refused if it is too deep, has a long list, or a name of private data."""
    if depth > DEPTH:
        raise Refusal("too_deep")
    if isinstance(value, str):
        return value[:CHARS]
    if isinstance(value, list):
        if len(value) > ITEMS:
            raise Refusal("array_too_large")
        return [safe(v, depth + 1) for v in value]
    if isinstance(value, dict):
        out = {}
        for key, v in value.items():
            if UNSAFE.search(key):
                raise Refusal("unsafe_key")
            out[key] = safe(v, depth + 1)
        return out
    return value


def _invalid(name: str) -> None:
    raise Refusal("invalid_value")


def sanitised(text: str | None) -> tuple[str | None, str | None]:
    """Safe metadata as compact JSON, or why it is refused; none is empty."""
    try:
        value = json.loads(text, parse_constant=_invalid) if text is not None else {}
        if not isinstance(value, dict):
            raise Refusal("invalid_value")
        out = json.dumps(safe(value), ensure_ascii=False, separators=(",", ":"))
        if len(out.encode("utf-8", "surrogatepass")) > BYTES:
            raise Refusal("too_large")
        return out, None
    except Refusal as why:
        return None, REFUSED + str(why)
    except RecursionError:
        return None, REFUSED + "too_deep"
    except ValueError:
        return None, REFUSED + "invalid_value"


@F.pandas_udf(StructType([StructField("metadata", StringType()), StructField("code", StringType())]))
def _sanitise(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sanitised(None if t is None or t is pd.NA else t) for t in text], columns=["metadata", "code"])


def safe_metadata(text: Column) -> Column:
    """K6: ``metadata`` (compact JSON, null if refused) and ``code`` (null if not) of untyped JSON metadata."""
    return _sanitise(text)


def append_events(stored_events: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6: the event log (id, ..., metadata) with new events, whose metadata is made safe; and the refused ones, with their code.

    The log is only added to: an event whose id it has is left out.
    """
    own = stored(events.withColumn("_safe", safe_metadata(c("metadata"))), "events")
    fresh = own.where("_safe.code is null").withColumn("metadata", c("_safe.metadata")).drop("_safe")
    fresh = fresh.dropDuplicates(["id"]).join(stored_events.select("id"), "id", "left_anti")
    return stored_events.unionByName(fresh.select(stored_events.columns)), own.where("_safe.code is not null").select("id", c("_safe.code").alias("code"))


def followed_sitemaps(documents: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (site, url) that a site's sitemaps name, and the sitemaps read (site, url, level).

    ``documents``: url, body of whatever was fetched; ``roots``: site, url to begin with. An index leads to sitemaps of the same host, each of
    which is read once, so indexes that name each other end; a round reads all sitemaps of one level of all sites.
    """
    site_of = lambda df: df.withColumn("same", U.bare_host(c("url")) == c("host"))
    frontier = cut(roots.select("site", "url", U.bare_host(c("url")).alias("host")).distinct())
    seen, pages, level = frontier.withColumn("level", F.lit(0)), None, 0
    while not frontier.isEmpty():
        level += 1
        read = frontier.join(documents.select("url", "body"), "url").select("site", "host", "body")
        found = stored(site_of(sitemap(read, "body", ["site", "host"])), "sitemaps")
        own = found.where("kind = 'page' and same").select("site", "url")
        pages = own if pages is None else pages.union(own)
        frontier = cut(found.where("kind = 'index' and same").select("site", "url", "host").distinct().join(seen.select("site", "url"), ["site", "url"], "left_anti"))
        seen = cut(seen.union(frontier.select("site", "url", "host", F.lit(level).alias("level"))))
    pages = pages.distinct() if pages is not None else roots.select("site", "url").limit(0)
    return pages, seen.join(documents.select("url"), "url", "left_semi").select("site", "url", "level")

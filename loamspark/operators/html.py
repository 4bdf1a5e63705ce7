"""HTML to semantic blocks, links and titles (X1, X3b, X3c, X3d) with the standard library's parser."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

#: What is skipped, and the kinds of blocks.
SKIPPED = frozenset("script style noscript template svg iframe head".split())
KINDS = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "paragraph", "li": "list_item", "tr": "table_row", "dd": "definition", "blockquote": "paragraph"}


@dataclass(frozen=True)
class Budget:
    """What may be read of one page, for those who want a crawler's budgets: without one pages are read whole."""

    nodes: int = 12_000
    chars: int = 50_000
    blocks: int = 500
    kinds: Mapping[str, int] = field(default_factory=lambda: {"heading": 80, "paragraph": 300, "list_item": 180})


class _Blocks(HTMLParser):
    def __init__(self, budget: Budget | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.limit, self.cut = budget.nodes if budget else None, False
        self.out: list[tuple[str, str]] = []
        self.skip = self.nodes = 0
        self.kind, self.parts, self.term = "", [], ""
        self.nav: list[tuple[int, int]] = []  # where an open list starts, and its links' characters
        self.link = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and self.kind:
            if self.kind == "definition" and self.term:
                text = f"{self.term}: {text}"
            self.out.append((self.kind, text))
        self.kind, self.parts = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.nodes += 1
        if tag in SKIPPED or any(k == "hidden" for k, _ in attrs):
            if tag in SKIPPED:
                self.skip += 1
            return
        if tag in KINDS or tag in ("ul", "ol", "dt", "table", "div", "section", "article", "nav", "footer"):
            self._flush()
        if tag in ("ul", "ol"):
            self.nav.append((len(self.out), 0))
        if tag in KINDS:
            self.kind = KINDS[tag]
        elif tag == "dt":
            self.kind = "term"
        elif tag in ("td", "th") and self.parts:
            self.parts.append(" | ")
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.link += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "dt":
            self.term, self.parts, self.kind = " ".join("".join(self.parts).split()), [], ""
        elif tag in KINDS or tag in ("div", "section", "article", "nav", "footer", "table"):
            self._flush()
        elif tag in ("ul", "ol") and self.nav:
            self._flush()
            start, linked = self.nav.pop()
            items = self.out[start:]
            # A navigation list: more than three items, all of them short links.
            if len(items) > 3 and all(len(t) <= 40 for _, t in items) and linked >= sum(len(t) for _, t in items):
                del self.out[start:]
        elif tag == "a":
            self.link = max(0, self.link - 1)

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.limit is not None and self.nodes > self.limit:
            self.cut |= bool(data.strip())
            return
        if self.kind or data.strip():
            self.kind = self.kind or "paragraph"
            self.parts.append(data)
            if self.link and self.nav:
                start, linked = self.nav[-1]
                self.nav[-1] = (start, linked + len(data.strip()))


def blocks_of(html: str, budget: Budget | None = None) -> tuple[list[tuple[str, str]], bool]:
    """(kind, text) of the blocks of a page in order, without repeated texts and navigation lists; and whether ``budget`` left some out."""
    parser = _Blocks(budget)
    parser.feed(html)
    parser.close()
    parser._flush()
    out, seen, count, size, cut = [], set(), Counter(), 0, parser.cut
    for kind, text in parser.out:
        key = re.sub(r"[\W_]+", " ", text.lower()).strip()
        if not key or key in seen:
            continue
        count[kind] += 1
        if budget and (count[kind] > budget.kinds.get(kind, budget.blocks) or len(out) >= budget.blocks or size > budget.chars):
            cut = True
            continue
        seen.add(key)
        size += len(text)
        out.append((kind, text))
    return out, cut


def semantic_blocks(pages: DataFrame, budget: Budget | None = None) -> DataFrame:
    """Blocks of pages (page_id, url, html), ready for the fact engine.

    Pages are read whole. With a ``budget`` the blocks of a page that it cuts have ``truncated``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, u, h in zip(b["page_id"], b["url"], b["html"], strict=True):
                found, cut = blocks_of(h or "", budget)
                rows += [(p, u, i, k, t, cut) for i, (k, t) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["page_id", "url", "ordinal", "type", "text", "truncated"])

    out = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, ordinal int, type string, text string, truncated boolean")
    return out.select(U.bare_host(F.col("url")).alias("site"), U.canonical(F.col("url")).alias("url"), "page_id", F.lit(None).cast("string").alias("declared"), "ordinal", T.clean(F.col("text")).alias("text"), "type", F.lit(False).alias("structured"), "truncated").where("text <> ''")


def title(html: Column, url: Column) -> Column:
    """The page's title, else its first heading, else the last segment of its path, else its host."""
    def inner(tag: str) -> Column:
        return F.nullif(T.clean(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", "")), F.lit(""))

    generic = lambda x: F.when(~x.rlike("(?i)^(home|homepage|untitled|index|welcome)$"), x)
    segment = F.nullif(F.element_at(F.split(F.regexp_replace(U.path(url), "/+$", ""), "/"), -1), F.lit(""))
    return F.coalesce(generic(inner("title")), generic(inner("h1")), segment, U.host(url))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, target) of the links of a page to its own host, each target once, in order."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]+)"""), F.lit(1))
    rows = pages.select("page_id", U.origin(F.col("url")).alias("origin"), F.posexplode(found).alias("place", "href"))
    full = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("/"), F.concat("origin", "href"))
    rows = rows.withColumn("target", U.dedupe(full)).where((U.origin(F.col("target")) == F.col("origin")) & U.discoverable(F.col("target")))
    return rows.groupBy("page_id", "target").agg(F.min("place").cast("long").alias("place"))

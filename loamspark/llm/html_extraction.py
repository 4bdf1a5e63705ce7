"""HTML extraction by equivalence-class template deduction.

Every page is a sequence of tokens: tags with the path of the elements around them, and whole
text nodes. Over the pages of one host a token has an occurrence vector, its count on each page.
Tokens with equal vectors form an equivalence class; classes that occur on enough pages and hold
enough tokens are valid, and those that lie inside one gap of another are nested in it; a class
that fits in no such way is dropped. Together they are the host's template. A text node counts
as supported by the pages that hold the element around it, and a tag by a small share of the
host, so that several layouts of one host each have their part of the template.

The template decides what is extracted, in two ways. Its text nodes are constant or frequent: blocks
that are wholly made of them are boilerplate, but for headings, and unless they hold most of an
article, as in near copies of one story (``extract`` has the shares). Its tags bound the slots: the main slot
is the innermost template element that holds most of the free text of the pages that have it; on
each page the innermost such element is taken, and its varying blocks are the result.

Names only settle what vectors cannot. Slots of menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments vary from page to page like the article does, so
elements so named are not free text; but a class counts only if every word of it is such a name
or a neutral word (``comment-list``, not ``has-sidebar``), never on headings, articles or main
elements, and no element that holds the article, or without one most of the page, is dropped for
its name. Where an ``article`` or ``main`` element stands around the main slot it is taken whole.
A page without a main slot of the template, or whose host has too few pages for a template, is
its own template: its article and main elements count, or else all its free text.

Vectors are never gathered: a token's vector is told by a sum over its pages of count times a
64-bit hash of the page, which tasks add up before the shuffle and Spark after it. So a host with
any number of pages costs a row for each different token, and nothing is grouped by host alone
but the tokens of valid classes, which are few for each page.

Defined results: null, empty and blank html gives an empty text. A null url is the host with the
empty name. Repeated rows count as pages of their own and give equal texts; a page that is wholly
template (its text stands on most pages of the host) keeps its text. Pages are read whole. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Element names, and the words in class, id and role that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
NAMED = frozenset("nav header footer aside form button select dialog menu head object canvas audio video".split())
CONTAINER = frozenset("html body div section article main table tbody thead tfoot tr ul ol dl center details blockquote figure fieldset".split())
BLOCK = CONTAINER | NAMED | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre hr br address figcaption caption option summary legend".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended newsletter "
    "subscribe signup popup modal comment comments disqus reply replies complementary contentinfo search hidden".split()
)
NEUTRAL = frozenset(
    "area bar bottom box block buttons container form google holder inner item law left links list main message outer page policy post posts reader readers right section site slot strip thread top unit user users "
    "view visitor widget wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())  #: a class says nothing about these

START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|[!?]|/(?=[^a-zA-Z]))")
ATTRIBUTES = re.compile(r"""(?:[^>=]++|=(?!\s*["']))*+(=\s*(?=["']))?""")
PLAIN_VALUE = re.compile(r"[^\s>]*")
EMPTY_COMMENT = re.compile(r"<!---?>")
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$|/)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
BIG = (1 << 64) - 1


@dataclass(frozen=True)
class Params:
    pages: int = 3  #: a valid class occurs on so many pages of the host at least,
    layout: float = 0.1  #: its tags on this share of the host's pages,
    share: float = 0.5  #: its text nodes on this share of the pages that hold the element around them,
    always: float = 0.95  #: (those on this share are constant, the others frequent)
    tokens: int = 2  #: and has so many tokens
    main: float = 0.6  #: share of the free text of its pages that the main slot holds
    broadcast: int = 500_000  #: template rows that are broadcast at most, else joined by host
    part: int = 1000  #: pages of a host in one part of that join, about


def _marked(name: str, attrs: str) -> bool:
    """Whether the class, id or role of an element says that it is boilerplate."""
    if not attrs or name in PLAIN:
        return False
    for mark in " ".join(x for m in MARK.findall(attrs) for x in m).lower().split():
        parts = [x for x in re.split(r"[^a-z]+", mark) if x]
        if not HINTS.isdisjoint(parts) and all(x in HINTS or x in NEUTRAL for x in parts):
            return True
    return bool(HIDDEN.search(attrs))


def _tag_end(html: str, at: int, missing: set[str]) -> int:
    """The place of the > that ends a tag whose attributes begin at ``at``, or -1. A quote counts as one only after =; one that is
    never closed is part of a plain value. ``missing`` remembers quotes that don't come any more, so a page is read once."""
    while m := ATTRIBUTES.match(html, at):
        at = m.end()
        if not m[1]:  # no = with a quote follows
            break
        quote = html[at]
        close = -1 if quote in missing else html.find(quote, at + 1)
        if close < 0:
            missing.add(quote)
            close = PLAIN_VALUE.match(html, at).end() - 1
        at = close + 1
    return at if at < len(html) and html[at] == ">" else -1


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of tags ("open", "close") and text nodes ("text").

    One pass over the page: comments, declarations and tags end where browsers end them; a comment, declaration or tag that
    never ends takes the rest of the page with it.
    """
    at, end, missing = 0, len(html), set()
    while at < end:
        m = START.search(html, at)
        if m is None:
            yield "text", html[at:], ""
            return
        if m.start() > at:
            yield "text", html[at : m.start()], ""
        if not m[2]:
            empty = EMPTY_COMMENT.match(html, m.start())
            comment = html.startswith("<!--", m.start())
            close = empty.end() if empty else html.find("-->", m.start() + 4) + 3 if comment else html.find(">", m.end()) + 1
            if not empty and close == (2 if comment else 0):  # never ends
                return
            at = close
            continue
        close = _tag_end(html, m.end(), missing)
        if close < 0:
            return
        name, attrs, at = m[2].lower(), html[m.end() : close], close + 1
        yield ("close" if m[1] else "open"), name, attrs
        if not m[1] and name in RAW and not attrs.endswith("/"):
            found = re.compile(rf"</{re.escape(name)}\b", re.I).search(html, at)
            at = found.start() if found else end


class Element:
    """An element around text: the one above it, its key, and what its name says."""

    __slots__ = ("above", "depth", "key", "lead", "marked", "name", "out")

    def __init__(self, name: str, above: int, depth: int, key: int, marked: bool, lead: bool):
        self.name, self.above, self.depth, self.key, self.marked, self.lead, self.out = name, above, depth, key, marked, lead, False


class Node:
    """A text node: its text, the element around it, whether a block begins with it, a link or a heading holds it."""

    __slots__ = ("at", "breaks", "heading", "key", "link", "text")

    def __init__(self, text: str, at: int, key: int, breaks: bool, link: bool, heading: bool):
        self.text, self.at, self.key, self.breaks, self.link, self.heading = text, at, key, breaks, link, heading


def page(html: str) -> tuple[list[Element], list[Node], list[tuple[int, int]]]:
    """The elements of a page (the first is the page itself), its text nodes, and its tags, each with the element around it, by keys."""
    elements = [Element("", 0, 0, 0, False, False)]
    stack, nodes, tags, open_ = [0], [], [], Counter()
    breaks, link, heading = True, False, False

    def leave() -> str:
        name = elements[stack.pop()].name
        open_[name] -= 1
        return name

    def key(*parts: str) -> int:
        return xxhash.xxh3_64_intdigest("\x00".join([str(elements[stack[-1]].key), *parts]))

    for kind, name, attrs in tokens(html):
        if kind == "text":
            if name and not name.isspace():
                nodes.append(Node(entities.unescape(name), stack[-1], key("text", " ".join(name.split())), breaks, link, heading))
                breaks = False
            elif name and nodes:
                nodes[-1].text += " "
            continue
        if name == "a":
            link = kind == "open"
        if name in BLOCK:
            heading = kind == "open" and name in HEADINGS
        if name in BLOCK:
            breaks = True
            while elements[stack[-1]].name == "p":  # any block ends an open paragraph
                leave()
        if kind == "close":
            if open_[name]:
                while leave() != name:
                    pass
            if name in CONTAINER or name in NAMED:
                tags.append((key("/" + name), elements[stack[-1]].key))
            continue
        marked = name in RAW or (name in NAMED and not (name == "header" and open_["article"])) or _marked(name, attrs)
        if name in VOID or not (marked or name in CONTAINER or name in NAMED) or (attrs.endswith("/") and name not in CONTAINER):
            continue
        marks = re.sub(r"\d+", "0", " ".join(x for m in MARK.findall(attrs) for x in m).lower()) if attrs else ""
        own, above = key(name, marks), stack[-1]
        tags.append((own, elements[above].key))
        lead = name in ("article", "main") and not (attrs and _marked("div", attrs))
        elements.append(Element(name, above, elements[above].depth + 1, own, marked, lead))
        stack.append(len(elements) - 1)
        open_[name] += 1

    # What is marked goes out, but for what holds most of the leads or, without one, of the page's text.
    size, led = [0] * len(elements), [0] * len(elements)
    for x in nodes:
        size[x.at] += 0 if x.link else len(x.text)
    inside = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        raw = e.name in RAW or e.name == "head"
        size[i] = 0 if raw else size[i]
        inside[i] = not raw and (e.lead or (inside[e.above] and not e.marked))
        led[i] = size[i] if inside[i] else 0
    for i in range(len(elements) - 1, 0, -1):
        above = elements[i].above
        size[above] += size[i]
        led[above] += led[i]
    for i, e in enumerate(elements[1:], 1):
        most = 2 * led[i] > led[0] if led[0] else (2 * size[i] > size[0] and e.name not in ("nav", "header", "footer", "aside", "menu"))
        e.out = elements[e.above].out or (e.marked and not most)
    return elements, nodes, tags


def extract(html: str, template: dict[int, str] | None = None) -> str:
    """The main text of a page; ``template`` has the keys of the host's texts that are constant ("text") or frequent ("often"), and of its main slots ("main").

    Constant and frequent blocks of the main slot are left out, but headings stay. Where constant ones hold over four fifths of
    its text they all stay, where frequent ones hold over half of the rest they do: the page is then one of many near copies,
    not a frame around an article.
    """
    elements, nodes, _ = page(html)
    template = template or {}
    slots = [i for i, e in enumerate(elements) if i and not e.out and template.get(e.key) == "main"]
    if slots:
        inner = max(slots, key=lambda i: (elements[i].depth, i))
        lead = [0] * len(elements)  # the nearest article or main element around each
        for i, e in enumerate(elements):
            lead[i] = i if e.lead else lead[e.above]
        slots = {lead[i] or i for i in slots if elements[i].key == elements[inner].key}
    else:
        slots = {i for i, e in enumerate(elements) if e.lead and not e.out}
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = i in slots or inside[e.above]
    held = [x for x in nodes if not elements[x.at].out and (inside[x.at] or not slots)]
    blocks: list[list[Node]] = []
    for x in held:
        if x.breaks or not blocks:
            blocks.append([])
        blocks[-1].append(x)
    size = lambda some: sum(len(x.text) for x in some if not x.heading)
    for role, most in (("text", 0.8), ("often", 0.5)):
        kept = [b for b in blocks if any(x.heading or template.get(x.key) != role for x in b)]
        all_of, rest = ([x for b in some for x in b] for some in (blocks, kept))
        if rest and size(rest) >= (1 - most) * size(all_of):
            blocks = kept
    varied = [x for b in blocks for x in b]
    return " ".join("".join((" " if x.breaks else "") + x.text for x in varied).split())


def host_column(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, "^.*?://([^/?#]*)", 1), F.lit("")))


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, the token of the element around it, kind, vector (low and high part), pages, and sums
    of free text inside and of free text of the page.

    Kinds: 0 a tag, 1 a text node, 2 the page itself (token 0).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int, int], list[int]] = {}

        def flush() -> pd.DataFrame:
            signed = lambda x: np.uint64(x).astype(np.int64)
            rows = [(h, signed(t), k, signed(v[4]), *v[1:4], signed(v[0])) for (h, t, k), v in total.items()]
            total.clear()
            return pd.DataFrame(rows, columns=["host", "token", "kind", "around", "pages", "chars", "whole", "vector"])

        for b in batches:
            for number, host, html in zip(b["number"], b["host"], b["html"], strict=True):
                elements, nodes, tags = page(html or "")
                seen = xxhash.xxh3_64_intdigest(number)
                size = [0] * len(elements)
                for x in nodes:
                    if not elements[x.at].out and not x.link:
                        size[x.at] += len(x.text)
                whole, chars = sum(size), Counter()
                for i in range(len(elements) - 1, 0, -1):  # keys hold the path, so none is met twice on the way up
                    size[elements[i].above] += size[i]
                    chars[elements[i].key] += size[i]
                outer = dict(tags)
                found = [(t, 0, n, chars[t], outer[t]) for t, n in Counter(t for t, _ in tags).items()]
                texts = {x.key: elements[x.at].key for x in nodes}
                found += [(t, 1, n, 0, texts[t]) for t, n in Counter(x.key for x in nodes).items()]
                found.append((0, 2, 1, whole, 0))
                for t, kind, n, size, above in found:
                    own = total.setdefault((host, t, kind), [0, 0, 0, 0, above])
                    own[0] = (own[0] + n * seen) & BIG
                    own[1], own[2], own[3] = own[1] + 1, own[2] + size, own[3] + whole
            if len(total) > 200_000:
                yield flush()
        yield flush()

    rows = pages.select(F.concat_ws("\x00", F.col("page_id").cast("string"), "url", F.xxhash64("html").cast("string")).alias("number"), host_column().alias("host"), "html")
    parts = rows.mapInPandas(run, "host string, token long, kind int, around long, pages long, chars long, whole long, vector long")
    # Sums of vectors wrap around; ANSI sums would not, so the two halves are added apart.
    half = [F.sum(F.col("vector").bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned("vector", 32)).alias("high")]
    return parts.groupBy("host", "token", "kind").agg(F.min("around").alias("around"), *half, *(F.sum(c).alias(c) for c in ("pages", "chars", "whole")))


def templates(spark: SparkSession, pages: DataFrame, params: Params, scratch: Scratch) -> DataFrame:
    """host, token and role ("main", "text" or "often") of the constant and frequent texts and the main slots of valid classes."""
    often = scratch.keep(occurrences(pages).where(f"pages >= {params.pages}"), "occurrences")
    hosts = often.where("kind = 2").select("host", F.col("pages").alias("host_pages"))
    tags = often.where("kind = 0").join(hosts, "host").where(F.col("pages") >= params.layout * F.col("host_pages")).drop("host_pages")
    outer = often.where("kind <> 1").select("host", F.col("token").alias("around"), F.col("pages").alias("around_pages"))
    texts = often.where("kind = 1").join(outer, ["host", "around"]).where(F.col("pages") >= params.share * F.col("around_pages"))
    always = (F.col("kind") == 1) & (F.col("pages") >= params.always * F.col("around_pages"))
    token = F.struct("token", "kind", "around", always.alias("always"), (F.col("chars") >= params.main * F.greatest("whole", F.lit(1))).alias("main"))
    # Supported tokens are a bounded multiple of those of one page, so a host's classes are few.
    classes = tags.withColumn("around_pages", F.lit(None).cast("long")).unionByName(texts).groupBy("host", "high", "low").agg(F.sort_array(F.collect_list(token)).alias("tokens"), F.max("pages").alias("pages"))
    classes = classes.where(F.size("tokens") >= params.tokens)

    def one_gap(inner: set[int], outer: set[int], up: dict[int, int]) -> bool:
        """Whether all tags of one class lie directly in the same element of the other, or all in none."""

        def gap(t: int) -> int:
            t = up.get(t, 0)
            while t and t not in outer:
                t = up.get(t, 0)
            return t

        return len({gap(t) for t in inner}) == 1

    def nest(b: pd.DataFrame) -> pd.DataFrame:
        """The template of one host, from its classes by number of pages."""
        up = {t["token"]: t["around"] for own in b["tokens"] for t in own if t["kind"] == 0}
        taken: list[set[int]] = []  # tags of each class
        rows = []
        for own in b["tokens"]:
            tags = {t["token"] for t in own if t["kind"] == 0}
            if tags and not all(one_gap(tags, x, up) or one_gap(x, tags, up) for x in taken):
                continue
            taken += [tags] if tags else []
            rows += [(b["host"].iloc[0], t["token"], ("text" if t["always"] else "often") if t["kind"] == 1 else "main") for t in own if t["kind"] == 1 or t["main"]]
        return pd.DataFrame(rows, columns=["host", "token", "role"])

    ordered = lambda b: nest(b.sort_values(["pages", "high", "low"], ascending=False))
    return scratch.keep(classes.groupBy("host").applyInPandas(ordered, "host string, token long, role string"), "templates")


def main_texts(spark: SparkSession, pages: DataFrame, params: Params = Params()) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    scratch = Scratch(spark, "html")
    found = templates(spark, pages, params, scratch)
    rows = pages.select("page_id", "url", "html", host_column().alias("host"))
    if found.count() <= params.broadcast:
        by_host: dict[str, dict[int, str]] = {}
        for r in found.toLocalIterator():
            by_host.setdefault(r["host"], {})[r["token"] & BIG] = r["role"]
        shared = spark.sparkContext.broadcast(by_host)

        @F.pandas_udf(T.StringType())
        def text(host: pd.Series, html: pd.Series) -> pd.Series:
            return pd.Series([extract(x or "", shared.value.get(h)) for h, x in zip(host, html, strict=True)], dtype=object)

        rows = rows.withColumn("text", text("host", "html"))
    else:

        @F.pandas_udf(T.StringType())
        def text_of(html: pd.Series, template: pd.Series) -> pd.Series:
            return pd.Series([extract(x or "", {t["token"] & BIG: t["role"] for t in own} if own is not None else None) for x, own in zip(html, template, strict=True)], dtype=object)

        # A host's pages are dealt over parts, each with its copy of the host's template.
        lists = found.groupBy("host").agg(F.collect_list(F.struct("token", "role")).alias("template"))
        size = max(params.part, rows.count() // 10_000)
        parts = rows.groupBy("host").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
        lists = scratch.keep(lists.join(parts, "host").select("host", "template", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "lists")
        most = F.broadcast(parts.where("parts > 1"))  # 10,000 rows at most, by the choice of size
        rows = rows.join(most, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("parts", F.lit(1))).cast("int"))
        rows = rows.join(lists, ["host", "part"], "left").withColumn("text", text_of("html", "template"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

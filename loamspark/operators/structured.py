"""What pages say of themselves: JSON-LD facts, link relations, names of businesses (X2, X3, X3f)."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

c = F.col

#: Types of entities that say something of a business.
SUPPORTED = frozenset(
    "organization localbusiness corporation professionalservice store product service offer aggregateoffer faqpage question answer person postaladdress openinghoursspecification contactpoint review aggregaterating".split()
)
LOCAL_BUSINESS = frozenset(
    "restaurant dentist plumber electrician attorney autorepair hotel medicalclinic realestateagent accountingservice automotivebusiness bakery barorpub beautysalon cafeorcoffeeshop childcare dayspa "
    "drycleaningorlaundry emergencyservice employmentagency entertainmentbusiness financialservice foodestablishment governmentoffice healthandbeautybusiness homeandconstructionbusiness insuranceagency "
    "legalservice library lodgingbusiness movingcompany notary professionalservice radiostation recyclingcenter selfstorage shoppingcenter sportsactivitylocation televisionstation touristinformationcenter "
    "travelagency veterinarycare bikestore bookstore clothingstore computerstore conveniencestore departmentstore electronicsstore florist furniturestore gardenstore grocerystore hardwarestore hobbystore "
    "homestore jewelrystore liquorstore mensclothingstore mobilestore moviestore musicstore officeequipmentstore outletstore pawnshop petstore shoestore sportinggoodsstore tireshop toystore wholesalestore".split()
)
#: The lines of an entity, in order: label and the properties of which the first that is there counts; url lines are marked.
LINES = (
    ("Legal name", "legalName"), ("Description", "description"), ("URL*", "url"), ("Logo*", "logo"), ("Founded", "foundingDate"), ("Slogan", "slogan"), ("Parent organization", "parentOrganization"), ("Brand", "brand"),
    ("Telephone", "telephone"), ("Email", "email"), ("Contact type", "contactType"), ("Address", "address"), ("Street address", "streetAddress"), ("Locality", "addressLocality"), ("Region", "addressRegion"),
    ("Postal code", "postalCode"), ("Country", "addressCountry"), ("Area served", "areaServed serviceArea"), ("Opening hours", "openingHours"), ("Opening hours", "dayOfWeek opens closes"), ("Category", "category"), ("Model", "model"),
    ("SKU", "sku"), ("Audience", "audience"), ("Provider", "provider"), ("Service type", "serviceType"), ("Price", "price"), ("Low price", "lowPrice"), ("High price", "highPrice"), ("Price currency", "priceCurrency"),
    ("Availability", "availability"), ("Eligible region", "eligibleRegion"), ("Price specification", "priceSpecification"), ("Minimum quantity", "eligibleQuantity minimumQuantity"), ("FAQ question", "name text"), ("FAQ answer", "acceptedAnswer"),
    ("FAQ answer", "text name"), ("Job title", "jobTitle"), ("Works for", "worksFor"), ("Affiliation", "affiliation"), ("Review body", "reviewBody"), ("Review author", "author"), ("Rating value", "ratingValue"),
    ("Review count", "reviewCount"), ("Rating count", "ratingCount"), ("External profile*", "sameAs"),
)
SHOWN = ("name", "description", "text", "value", "price", "ratingValue", "@id")
HOURS = "dayOfWeek opens closes"
#: Lines whose properties an entity must have for them to be said; hours are said of their type alone.
NEEDS = [(label, keys, () if keys == HOURS else tuple(keys.split())) for label, keys in LINES]
ADDRESS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
NOTHING = re.compile("null|undefined|unknown|n/a", re.I)
VALUE_CHARS, LIST_ITEMS, URLS = 500, 20, 10
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Limits:
    """A crawler's budget for a page: nesting and entities that are looked at, lines that are kept. None reads all."""

    depth: int | None = None
    items: int | None = None
    facts: int | None = None


def scalar(value: object, depth: int = 0) -> str:
    """A value as a line shows it: plain values, lists, and of objects what names them."""
    if depth > 3 or value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        value = int(value) if math.isfinite(value) and value == int(value) and abs(value) < 1e21 else value
    if isinstance(value, (str, int, float)):
        return SPACE.sub(" ", str(value)).strip()[:VALUE_CHARS]
    if isinstance(value, list):
        return ", ".join(x for x in (scalar(v, depth + 1) for v in value[:LIST_ITEMS]) if x)[:VALUE_CHARS]
    return scalar(next((value[k] for k in SHOWN if value.get(k) is not None), None), depth + 1)


def web_urls(value: object) -> list[str]:
    items = value[: 2 * URLS] if isinstance(value, list) else [value]
    found = [scalar(x.get("@id")) if isinstance(x, dict) else scalar(x) for x in items]
    full = [re.sub(r"^(https?://)([^/?#]*)$", r"\1\2/", x) for x in found if re.match(r"https?://[^/?#\s]+", x)]
    return list(dict.fromkeys(x[:VALUE_CHARS] for x in full))[:URLS]


def entity_lines(entity: dict, named: dict[str, dict]) -> Iterator[tuple[str, str]]:
    """(label, value) of an entity of a supported type, ``named`` having the page's entities by @id."""
    types = entity.get("@type")
    types = {str("" if t is None else t).lower() for t in (types if isinstance(types, list) else [types])}
    if types.isdisjoint(SUPPORTED) and types.isdisjoint(LOCAL_BUSINESS):
        return
    first = lambda keys: next((entity[k] for k in keys.split() if entity.get(k) is not None), None)
    who = "Person" if "person" in types else "Product" if "product" in types else "Service" if types & {"service", "professionalservice"} else "Business"
    yield f"{who} name", scalar(entity.get("name"))
    for label, keys, needs in NEEDS:
        if needs and entity.keys().isdisjoint(needs):
            continue
        if label.endswith("*"):
            yield from ((label[:-1], x) for x in web_urls(entity.get(keys)))
        elif keys == "address":
            own = entity.get("address")
            if isinstance(own, dict):
                yield label, ", ".join(x for x in (scalar(own.get(k)) for k in ADDRESS) if x)
        elif keys == HOURS:
            if "openinghoursspecification" in types:
                day, opens, closes = (scalar(entity.get(k)) for k in keys.split())
                yield label, f"{day} {opens}-{closes}".strip()
        elif label == "FAQ question":
            if "question" in types:
                yield label, scalar(first(keys))
        elif keys == "acceptedAnswer":
            if "question" in types:
                answers = entity.get(keys)
                for a in (answers if isinstance(answers, list) else [answers])[:LIST_ITEMS]:
                    yield label, scalar(named.get(str(a.get("@id") or ""), a) if isinstance(a, dict) else a)
        elif label == "FAQ answer":
            if "answer" in types:
                yield label, scalar(first(keys))
        else:
            yield "Aggregate rating" if keys == "ratingValue" and "aggregaterating" in types else label, scalar(first(keys))


def entities_of(value: object, limits: Limits) -> Iterator[dict]:
    """All objects of a parsed document, each before what it holds, in order; nested as deep as it may be."""
    stack, count = [(value, 0)], 0
    while stack:
        x, depth = stack.pop()
        if limits.depth is not None and depth > limits.depth or limits.items is not None and count >= limits.items:
            continue
        if isinstance(x, dict):
            count += 1
            yield x
            x = list(x.values())
        if isinstance(x, list):
            stack += [(v, depth + 1) for v in reversed(x) if isinstance(v, (dict, list))]


def lines_of(blocks: list[str], limits: Limits) -> tuple[list[str], int, int]:
    """The lines of a page's JSON-LD blocks, the number of its entities, and of blocks that are no JSON."""
    named: dict[str, dict] = {}
    lines, count, broken = [], 0, 0
    for block in blocks:
        try:
            found = list(entities_of(json.loads(block.strip()), limits))
        except (ValueError, RecursionError):
            broken += 1
            continue
        for e in found:
            if isinstance(e.get("@id"), str) and e["@id"].strip():
                named.setdefault(e["@id"].strip(), e)
        for e in found:
            own = [f"{label}: {value}" for label, value in entity_lines(e, named) if value and not NOTHING.fullmatch(value)]
            types = e.get("@type")
            count += any(str(t).lower() in SUPPORTED or str(t).lower() in LOCAL_BUSINESS for t in (types if isinstance(types, list) else [types]))
            lines += own
    return lines, count, broken


def json_ld_blocks(html: Column) -> Column:
    """The texts of a page's JSON-LD scripts."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>.*?</script\s*>"), F.lit(0))
    kind = lambda s: F.lower(F.trim(F.regexp_extract(s, r"""(?is)^<script\b[^>]*?\btype\s*=\s*["']?([^\s"'>]+)""", 1)))
    return F.transform(F.filter(scripts, lambda s: kind(s) == "application/ld+json"), lambda s: F.regexp_replace(s, r"(?is)^<script\b[^>]*>|</script\s*>$", ""))


def json_ld(pages: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(page_id, nth, line) of the facts of pages (page_id, html), each said once by its normalised text, and a page's counts.

    References by @id are followed within a page; a block that is no JSON says nothing and is counted. The second table has
    page_id, blocks, broken, entities, said (lines before repeats are dropped).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [lines_of(list(x), limits) for x in b["blocks"]]
            yield pd.DataFrame({"page_id": b["page_id"], "blocks": [len(x) for x in b["blocks"]], "lines": [f[0] for f in found], "entities": [f[1] for f in found], "broken": [f[2] for f in found]})

    own = pages.select("page_id", json_ld_blocks(c("html")).alias("blocks")).where(F.size("blocks") > 0)
    own = own.mapInPandas(run, "page_id long, blocks int, lines array<string>, entities int, broken int")
    each = own.select("page_id", F.posexplode("lines").alias("nth", "line")).withColumn("key", T.page_text(c("line")))
    once = each.groupBy("page_id", "key").agg(F.min(F.struct("nth", "line")).alias("first")).select("page_id", "first.nth", "first.line")
    if limits.facts is not None:  # a page's lines are few enough for one sort
        once = once.groupBy("page_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("nth", "line"))), 1, limits.facts).alias("all")).select("page_id", F.inline("all"))
    return once, own.select("page_id", "blocks", "broken", "entities", F.size("lines").alias("said"))


def resolved(href: Column, page: Column) -> Column:
    """A reference of a page as a full url; null if it has another scheme or climbs (``..``) out of what can be told here."""
    scheme = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.concat(U.origin(page), F.regexp_replace(U.path(page), "[^/]*$", ""))
    out = F.when(href.rlike("(?i)^https?://"), href).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(href.startswith("//"), F.concat(scheme, href))
    out = out.when(href.startswith("/"), F.concat(U.origin(page), href)).when(href.startswith("?") | href.startswith("#"), F.concat(U.origin(page), U.path(page), href))
    return out.otherwise(F.concat(folder, F.regexp_replace(href, r"^(\./)+", "")))


def link_relations(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first canonical url of each page (page_id, canonical) and its alternates (page_id, place, url, language).

    Only urls of the page's own host that may be discovered count; the second table's rows with a null url are alternates that were ignored.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    # The group is what the quote of the attribute ends; an attribute without quotes doesn't count.
    attribute = lambda name: F.trim(F.replace(F.coalesce(*(F.nullif(F.regexp_extract("tag", rf"(?is)\b{name}\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in "\"'"), F.lit("")), F.lit("&amp;"), F.lit("&")))
    rows = pages.select("page_id", c("url").alias("page"), F.posexplode(tags).alias("place", "tag"))
    rows = rows.select("page_id", "page", "place", F.split(F.lower(attribute("rel")), r"\s+").alias("rel"), attribute("href").alias("href"), F.lower(attribute("hreflang")).alias("language")).where("href <> ''")
    rows = rows.withColumn("full", resolved(c("href"), c("page")))
    good = (U.bare_host(c("full")) == U.bare_host(c("page"))) & U.discoverable(c("full"))
    rows = rows.withColumn("target", F.when(good, U.dedupe(c("full"))))
    canonical = rows.where(F.array_contains("rel", "canonical") & c("target").isNotNull()).groupBy("page_id").agg(F.min_by("target", "place").alias("canonical"))
    return canonical, rows.where(F.array_contains("rel", "alternate")).select("page_id", "place", c("target").alias("url"), "language")


#: Titles that name no business, and labels of a site's own pages.
GENERIC = ("home", "homepage", "welcome", "official site", "website")
INTERNAL = r"(?i)^(?:contact(?: us)?|about(?: us)?|services?|products?|pricing|faqs?|terms|privacy(?: policy)?)$"


def business_names(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """X3f: site and name: what was extracted, else the first part of the home page's title, else the host's first label.

    ``sites``: site, extracted, url; ``pages``: site, place, type, title. The home page is the first of that type, or else the first.
    """
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    own = pages.withColumn("title", title)
    home = own.groupBy("site").agg(F.min_by("title", F.struct((c("type") != "home").alias("other"), "place")).alias("home"))
    extracted = F.trim(F.regexp_replace(F.coalesce("extracted", F.lit("")), r"\s+", " "))
    inside = own.where("type <> 'home' and title <> ''").select("site", F.lower("title").alias("low")).distinct()
    out = sites.withColumns({"extracted": extracted, "low": F.lower(extracted)}).join(home, "site", "left").join(inside.withColumn("is_page", F.lit(True)), ["site", "low"], "left")
    candidate = F.trim(F.get(F.split(F.coalesce("home", F.lit("")), r"\s(?:\||[-–—]|::)\s"), F.lit(0)))
    label = F.initcap(F.regexp_replace(F.get(F.split(F.regexp_replace(U.host(c("url")), r"^www\.|:[0-9]+$", ""), r"\."), F.lit(0)), "[-_]+", " "))
    usable = (c("extracted") != "") & ~c("extracted").rlike(INTERNAL) & c("is_page").isNull()
    return out.select("site", F.when(usable, c("extracted")).when((candidate != "") & ~F.lower(candidate).isin(*GENERIC), candidate).otherwise(label).alias("name"))

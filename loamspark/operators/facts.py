"""The fact engine: blocks to scored facts, conflicts, coverage and FAQs.

Blocks are rows (site, url, page_id, ordinal, type, text, declared, structured). Everything stays
in column expressions; the rule table becomes one array of conditions, so each sentence is read once and
nothing is joined to the rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules as K
from ..functions import text as T
from ..functions import urls as U
from ..session import stored


def text_blocks(docs: DataFrame, url: Column, declared: Column) -> DataFrame:
    """Lines of documents (doc_id, text, source) as blocks; a short first line is a heading.

    Documents are dealt by id first: one file of many is read by one task, and windows over pages need no other shuffle.
    """
    lines = docs.repartition("doc_id").select(F.col("source").alias("site"), url.alias("url"), F.col("doc_id").alias("page_id"), declared.alias("declared"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ordinal", "text"))
    lines = lines.withColumn("text", T.clean(F.col("text"))).where("text <> ''")
    kind = F.when((F.col("ordinal") == 0) & (F.length("text") <= 80), "heading").otherwise("paragraph")
    return lines.withColumn("type", kind).withColumn("structured", F.lit(False))


def with_page_type(blocks: DataFrame) -> DataFrame:
    """The declared type, else the first pattern that the page's signals match, else home or other.

    Type, url and heading decide, so a row that shares them with the one before takes its type. Signals are a column
    of their own, which is computed once for all patterns.
    """
    page = W.partitionBy("page_id").orderBy("ordinal")
    same = [F.col(x).eqNullSafe(F.lag(x).over(page)) for x in ("declared", "url", "heading")]
    own = blocks.withColumn("_new", (F.row_number().over(page) == 1) | ~(same[0] & same[1] & same[2]))
    declared = F.when(F.col("_new"), T.key_text(F.col("declared")))
    own = own.withColumn("_own", declared).withColumn("_own", F.when(F.col("_own") == "homepage", "home").otherwise(F.col("_own")))
    own = own.withColumn("_signals", F.when(F.col("_new"), T.key_text(F.concat_ws(" ", "_own", U.path(F.col("url")), F.coalesce("heading", F.lit(""))))))
    out = F.when(F.col("_own").isin(*K.DECLARED), F.col("_own"))
    for name, pattern in K.PAGE_TYPES:
        out = out.when(T.matches(F.col("_signals"), pattern), name)
    own = own.withColumn("_type", F.when(F.col("_new"), out.when(U.path(F.col("url")) == "/", "home").otherwise("other")))
    found = F.last("_type", ignorenulls=True).over(page.rowsBetween(W.unboundedPreceding, W.currentRow))
    return own.withColumn("page_type", found).drop("_new", "_own", "_signals", "_type")


def normalise(blocks: DataFrame) -> DataFrame:
    """Heading, page type and neighbours of each block that is kept.

    Three branches read the headed blocks, so these are written once: their pages are parsed and normalised once.
    """
    order = W.partitionBy("page_id").orderBy("ordinal")
    before = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = blocks.withColumn("heading", F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(before))
    # Only texts that the filter can drop meet the counts, so a line on every page costs no skewed join, and only texts
    # with a word of theirs get a key: equal keys have equal words. A NUL inside a word is no part of its key.
    low = F.lower("text")
    alike = reduce(Column.__or__, (low.contains(w) for w in (*K.REPEATED_WORDS, "\x00")))
    own = stored(with_page_type(own).withColumn("alike", alike), "headed-blocks")
    alike = own.where("alike").withColumn("key", F.xxhash64(T.key_text(F.col("text"))))
    urls = alike.groupBy("site", "key").agg(F.countDistinct("url").alias("urls")).where("urls > 1").select("site", "key")
    risky = T.matches(F.col("text"), K.REPEATED_DROPPED) & ~T.matches(F.col("text"), K.REPEATED_KEPT)
    dropped = alike.where(risky).join(urls, ["site", "key"], "left_semi").groupBy("page_id").agg(F.collect_set("ordinal").alias("dropped"))
    chrome = (F.length("text") <= K.CHROME_LENGTH) & T.matches(F.col("text"), K.CHROME)
    # Joined by page, so that the windows need no shuffle of their own.
    kept = own.where(~chrome).join(dropped, "page_id", "left").where(F.coalesce(~F.array_contains("dropped", F.col("ordinal")), F.lit(True))).drop("alike", "dropped")
    return kept.withColumns({"previous_type": F.lag("type").over(order), "previous_text": F.lag("text").over(order), "next_ordinal": F.lead("ordinal").over(order)})


def fallback_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """R2: the whole text of pages (page_id, url, site, declared, text) without a usable body block."""
    usable = blocks.where((F.col("type") != "heading") & ~T.matches(F.col("text"), K.CHROME)).select("page_id")
    rest = pages.where("text <> ''").join(usable, "page_id", "left_anti")
    return rest.select("site", "url", "page_id", "declared", F.lit(0).alias("ordinal"), T.clean(F.col("text")).alias("text"), F.lit("page_text").alias("type"), F.lit(False).alias("structured"))


def routed(blocks: DataFrame) -> DataFrame:
    """The evidence lane of normalised blocks; other pages with prices or lists are commercial."""
    blocks = blocks.withColumn("_signal", T.clean(F.concat_ws(" ", F.coalesce("heading", F.lit("")), "url")))
    signal = F.col("_signal")
    lane = F.lit(None).cast("string")
    for name, pattern in reversed(K.LANES):
        lane = F.when(T.matches(signal, pattern), name).otherwise(lane)
    by_page = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in K.PAGE_LANES.items() for x in kv)), F.col("page_type")), F.lit("unknown"))
    page = W.partitionBy("url")
    body = ~F.col("type").isin("heading", "faq_question")
    listed = F.col("type").isin(*K.STRUCTURED)
    first_type = F.min(F.struct("ordinal", "page_type")).over(page)["page_type"]
    lanes = dict(K.LANES)
    blocked = T.matches(F.col("url"), lanes["legal"]) | T.matches(F.col("url"), lanes["editorial"]) | T.matches(F.col("url"), lanes["proof"])
    priced = F.count_if(body & T.matches(F.col("text"), K.PRICE)).over(page) > 0
    catalog = F.count_if(body & listed).over(page) > F.count_if(body & ~listed).over(page)
    promoted = (first_type == "other") & ~blocked & (priced | catalog)
    own = blocks.withColumn("_lane", F.coalesce(lane, by_page)).withColumn("_promoted", promoted)
    return own.withColumn("lane", F.when((F.col("_lane") == "unknown") & F.col("_promoted"), "commercial").otherwise(F.col("_lane"))).drop("_lane", "_promoted", "_signal")


def rule_hits(sentence: Column, page: Column, context: Column) -> Column:
    """(category, title) of each rule that fires, one for a category, by priority."""
    # Each group after a word's edge begins with a letter or digit, so only what is before it need be looked at.
    said = lambda pattern, ignore_case=True: T.matches(sentence, pattern.replace(r"\b(?:", r"(?<![A-Za-z0-9_])(?:"), ignore_case)
    tracking, standard = said(K.TRACKING), said(K.STANDARD)
    hits = []
    for rule in K.ORDERED:
        fires = said(rule.evidence, rule.ignore_case)
        if rule.pages:
            fires = page.isin(*rule.pages) & fires
        if rule.heading:
            fires &= T.matches(context, rule.heading)
        if rule.category == "certification":
            fires &= ~standard
        if rule.category in K.COMMERCIAL:
            fires &= ~tracking
        hits.append(F.when(fires, F.struct(F.lit(rule.category).alias("category"), F.lit(rule.title).alias("rule_title"))))
    none = F.array().cast("array<struct<category:string,rule_title:string>>")

    def first(acc: Column, hit: Column) -> Column:
        return F.when(F.exists(acc, lambda h: h["category"] == hit["category"]), acc).otherwise(F.concat(acc, F.array(hit)))

    # The fold reads the array of hits once, so each rule meets a sentence once.
    return F.when(~said(K.CONTRACT), F.aggregate(F.array_compact(F.array(*hits)), none, first)).otherwise(none)


def may_hit(text: Column) -> Column:
    """Whether a rule can fire in a sentence of a text: one pattern, by the first letters of words, for what all rules look for.

    Blanks of the patterns stand for any white space, as sentences are cut from texts and cleaned; a NUL may part words.
    """
    words = "|".join(f"{first}(?:{rest})" for first, rest in K.WORDS.items())
    pattern = rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])".replace("[- ]", f"[-{T.SPACES}]").replace(" ?", T.SPACES + "*").replace(" ", T.SPACES + "+")
    signs = [text.contains(sign) for sign in (*K.SIGNS, "\x00")]
    return reduce(Column.__or__, signs) | text.rlike(pattern + "|" + K.DIGITS.replace(" ", T.SPACES))


def said(blocks: DataFrame) -> DataFrame:
    """The sentences of body blocks in which a rule can fire, and the context of each: most texts are left before they are cut."""
    context = F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.when(F.col("previous_type") == "heading", F.col("previous_text")).otherwise(""))
    body = blocks.where(~F.col("type").isin("heading", "faq_question") & may_hit(F.col("text"))).withColumn("context", context)
    return body.withColumn("sentence", F.explode(F.filter(T.sentences(F.col("text")), may_hit)))


def _name(value: Column) -> Column:
    bare = F.regexp_replace(T.clean(value), "(?i)" + K.NAME_NOISE, "")
    return F.nullif(F.regexp_replace(bare, r"^[\s:–—-]+|[\s:–—-]+$", ""), F.lit(""))


def _group(text: Column, pattern: str) -> Column:
    return _name(F.regexp_extract(text, T.ascii_words(pattern, True), 1))


def item_name(category: Column, value: Column) -> Column:
    """The item's own name in its sentence, by the category's patterns; null if none fits."""
    out = F.lit(None).cast("string")
    for name, patterns in K.NAMED.items():
        found = F.coalesce(*(_group(value, p) for p in patterns))
        if name == "location_service_area":
            found = F.coalesce(found, F.when(T.clean(value).rlike(K.BARE_PLACE), _name(value)))
        out = F.when(category == name, found).otherwise(out)
    return out


def with_topic_key(facts: DataFrame, suggested: Column) -> DataFrame:
    """topic_key of facts (category, value, heading): FAQ by question, shared aliases, then names.

    Each step is a column of its own, so that an expression used twice is computed once.
    """
    category, value, heading = F.col("category"), F.col("value"), F.col("heading")
    evidence = F.col("_evidence")
    spaces = F.create_map(*(F.lit(x) for kv in K.TOPIC_SPACES.items() for x in kv))
    contact = F.when(T.matches(evidence, r"\bsupport\b"), "support").when(T.matches(evidence, r"\bsales\b"), "sales")
    contact = F.coalesce(contact, *(F.nullif(F.regexp_extract(evidence, T.ascii_words(p, True), 0), F.lit("")) for p in (K.EMAIL, K.PHONE)))
    title = F.when(~T.matches(F.col("_title"), K.GENERIC_HEADINGS), F.nullif(F.col("_title"), F.lit("")))
    items = ("product", "service", "industry_served", "location_service_area", "primary_use_case")
    own = F.when(category == "policy", _group(evidence, K.POLICY_NAME)).when(category == "contact_information", contact)
    own = own.when(category == "integration", _group(value, r"\b(?:with|to|for)\s+(.+?)(?:[.!]|$)"))
    own = own.when(category.isin(*items), F.when(F.col("_item").isNotNull() & ~T.matches(F.col("_item"), K.BARE_ITEM), F.col("_item")).otherwise(title))
    own = own.when(category == "pricing_plan", F.col("_item"))
    alias = F.lit(None).cast("string")
    for name, identity, pattern in reversed(K.TOPIC_ALIASES):
        alias = F.when((category == name) & T.matches(evidence, pattern), f"{name}:{identity}").otherwise(alias)
    rest = F.concat(F.coalesce(F.element_at(spaces, category), category), F.lit(":"), F.when(F.col("_identity") == "", "unknown").otherwise(F.col("_identity")))
    question = F.concat(F.lit("faq:"), T.slug(F.coalesce(F.nullif(suggested, F.lit("")), value)))
    return (
        facts.withColumns({"_evidence": F.concat_ws(" ", F.coalesce(heading, F.lit("")), value), "_title": T.clean(heading), "_item": item_name(category, value), "_offered": _name(suggested)})
        .withColumn("_own", own)
        .withColumn("_identity", T.slug(F.coalesce("_own", "_item", "_offered", value)))
        .withColumn("topic_key", F.when(category == "faq", question).otherwise(F.coalesce(alias, rest)))
        .drop("_evidence", "_title", "_item", "_offered", "_own", "_identity")
    )


def _entity(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(T.clean(value), r"(?i)^(?:and|or)\s+", ""), "[.,:;]+$", "")


def expansions(category: Column, sentence: Column) -> Column:
    """The items of an enumeration in a sentence, by the category's wording."""
    def listed(lead: str) -> Column:
        found = F.regexp_extract(sentence, T.ascii_words(rf"\b(?:{lead})\s+(.+?)(?:[.!]|$)", True), 1)
        return F.filter(F.transform(F.split(found, T.ascii_words(r"\s*(?:,|\band\b|\bor\b)\s*", True)), _entity), lambda x: x != "")

    def every(pattern: str, ignore_case: bool = True) -> Column:
        return F.regexp_extract_all(sentence, F.lit(T.ascii_words(pattern, ignore_case)), F.lit(1))

    work = T.ascii_words(rf"\b(?:{K.WORK_WORDS})\b", True)
    tool = T.ascii_words(rf"\b(?:{K.TOOL_WORDS})\b", True)
    plans = F.transform(every(r"\b([A-Z][A-Za-z0-9 '&-]*?)\s+(?:plan|package|tier|subscription)\b", False), lambda x: F.concat(x, F.lit(" plan")))
    found = F.when(category == "security_compliance", every(r"\b(SOC\s*(?:II|2)|HIPAA|ISO\s*27001|GDPR|encryption|encrypted|SSO|MFA)\b"))
    found = found.when(category == "integration", F.filter(listed("integrates? with|connects? (?:to|with)|compatible with|plugins? for"), lambda x: x.rlike(r"^[A-Z][A-Za-z0-9 .+&-]+$")))
    found = found.when(category == "pricing_plan", plans)
    services = F.transform(listed("we (?:offer|provide|deliver)|our services? include"), lambda x: F.regexp_replace(x, r"(?i)\s+services?$", ""))
    found = found.when(category == "service", F.filter(services, lambda x: x.rlike(work)))
    found = found.when(category == "product", F.filter(listed("our products? include|we (?:offer|sell)|products?:"), lambda x: x.rlike(tool)))
    found = found.when(category == "location_service_area", F.filter(listed("(?:offices? (?:are )?(?:located )?in)|(?:we )?serve|available (?:in|throughout)|serving"), lambda x: x.rlike(K.BARE_PLACE)))
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), _entity), lambda x: T.key_text(x) != "")


def several(found: Column) -> Column:
    """The items without repeats (by key text), if there were several; else an empty array."""
    keys = F.transform(found, T.key_text)
    first = F.filter(found, lambda x, i: F.array_position(keys, T.key_text(x)) == i + 1)
    return F.when(F.size(found) > 1, first).otherwise(F.array().cast("array<string>"))


def extract(blocks: DataFrame) -> DataFrame:
    """Facts of normalised blocks, with their one piece of evidence."""
    hits = said(blocks).withColumn("hit", F.explode(rule_hits(F.col("sentence"), F.col("page_type"), F.col("context"))))
    hits = hits.withColumn("category", F.col("hit.category"))
    hits = hits.withColumn("found", expansions(F.col("category"), F.col("sentence"))).withColumn("items", several(F.col("found")))
    each = hits.withColumn("value", F.explode(F.when(F.size("items") > 0, F.col("items")).otherwise(F.array("sentence"))))
    category, value = F.col("category"), F.col("value")
    good = (F.length("heading") >= 3) & ~T.matches(F.col("heading"), K.GENERIC_TITLE)
    facts = with_topic_key(each, value)
    fact_id = T.stable_id("det_fact", F.concat_ws("\x00", "topic_key", T.key_text(value), F.lit("website")))
    evidence = F.struct("url", "page_id", "ordinal", F.col("sentence").alias("excerpt"), "heading", "page_type", "structured")
    return facts.select("site", fact_id.alias("fact_id"), "category", F.when(good, F.col("heading")).otherwise(F.col("hit.rule_title")).alias("title"), "value", "topic_key", F.lit("website").alias("provenance"), F.lit(True).alias("explicit"), evidence.alias("evidence"))


def is_proof(category: Column, title: Column, value: Column) -> Column:
    return (category == "additional_business_knowledge") & T.matches(F.concat_ws(" ", title, value), K.PROOF)


def grouping_key(category: Column, title: Column, value: Column, topic: Column) -> Column:
    agreement = F.regexp_replace(F.regexp_replace(T.key_text(value), T.ascii_words(T.ARTICLES), ""), " +", " ")
    return F.when(is_proof(category, title, value), "additional_business_knowledge:customer_proof").when(category.isin(*K.AGGREGATED), topic).otherwise(F.concat_ws("\x00", topic, agreement))


def quality(value: Column, provenance: Column, structured: Column) -> Column:
    out = F.when(provenance == "owner", 100).otherwise(0) + F.when(structured, 20).otherwise(0)
    return out + F.when(T.matches(value, K.GOOD_EVIDENCE), 6).otherwise(0) - F.when(T.matches(value, K.BAD_EVIDENCE), 25).otherwise(0)


def deduplicate(facts: DataFrame) -> DataFrame:
    """One fact for each group of a site, with the evidence of all and its measures.

    A group's evidence is counted, not listed: a group may hold a large part of all facts, so only
    sums, flags and the winner are kept, each of which Spark combines before the shuffle.
    """
    key = grouping_key(F.col("category"), F.col("title"), F.col("value"), F.col("topic_key"))
    rank = quality(F.col("value"), F.col("provenance"), F.col("evidence.structured"))
    own = facts.withColumn("group", key).withColumn("rank", rank)
    own = own.withColumn("ekey", F.xxhash64("evidence.page_id", "evidence.ordinal", "evidence.url", T.key_text(F.col("evidence.excerpt"))))
    relevant = F.create_map(*(x for c, pages in K.RELEVANT_PAGES.items() for x in (F.lit(c), F.array(*map(F.lit, pages)))))
    on_topic = F.coalesce(F.array_contains(F.element_at(relevant, F.col("category")), F.col("evidence.page_type")), F.lit(False))
    own = own.withColumns({"on_topic": on_topic, "headed": F.coalesce(F.col("evidence.heading") != "", F.lit(False))})
    # The winner: the owner's, then the best quality, then the least id (ids are hexadecimal, compared as text).
    best = F.min_by(F.struct("fact_id", "category", "title", "value", "topic_key", "provenance", "explicit"), F.struct((F.col("provenance") != "owner").alias("o"), (-F.col("rank")).alias("r"), "fact_id", "value"))
    merged = own.groupBy("site", "group").agg(best.alias("best"), F.count("*").alias("n_facts"), F.countDistinct("ekey").alias("n_evidence"), F.countDistinct("evidence.url").alias("n_urls"), F.bool_or("evidence.structured").alias("structured"), F.bool_or("headed").alias("headed"), F.bool_or("on_topic").alias("on_topic"))
    proof = F.col("group") == "additional_business_knowledge:customer_proof"
    return merged.select("site", "group", "best.*", "n_facts", "n_evidence", "n_urls", "structured", "headed", "on_topic").withColumns({
        "topic_key": F.when(proof, F.col("group")).otherwise(F.col("topic_key")),
        "title": F.when(proof, "Customer proof").otherwise(F.col("title")),
    })


def material(value: Column) -> Column:
    """X11: money, durations, shares and addresses of a value, sorted; else its key text."""
    text = T.key_text(value)
    found = F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(K.MATERIAL), F.lit(0))), "|")
    return F.when(found == "", text).otherwise(found)


def conflicts(facts: DataFrame) -> DataFrame:
    """X11, A3: topics of a site with two facts and two material values, and the preferred fact."""
    own = facts.withColumn("material", F.xxhash64(material(F.col("value"))))
    first = F.min_by("fact_id", F.struct((F.col("provenance") != "owner").alias("o"), "fact_id"))
    out = own.groupBy("site", "topic_key").agg(F.count("*").alias("n"), F.countDistinct("material").alias("n_values"), first.alias("preferred"), F.bool_or(F.col("provenance") == "owner").alias("with_owner"))
    return out.where("n >= 2 and n_values >= 2")


def scored(facts: DataFrame, found: DataFrame) -> DataFrame:
    """Confidence score and level of deduplicated facts."""
    own = facts.join(found.select("site", "topic_key", F.lit(True).alias("conflict")), ["site", "topic_key"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    plus = lambda c, n: F.when(c, n).otherwise(0)
    score = F.when(F.col("provenance") == "owner", 82).otherwise(46) + plus(F.col("explicit"), 10) + plus(F.col("structured"), 8) + plus(F.col("headed"), 5) + plus(F.col("on_topic"), 8)
    score = score + F.least(F.lit(12), (F.col("n_evidence") - 1) * 4) + F.least(F.lit(8), (F.col("n_urls") - 1) * 4)
    score = score - plus(F.length("value") < 20, 8) - plus(T.matches(F.col("value"), K.HEDGE), 8) - plus(F.col("conflict"), 18)
    own = own.withColumn("score", F.greatest(F.lit(5), F.least(F.lit(99), score)).cast("long"))
    return own.withColumn("confidence", T.level(F.col("score")))


def assessed(facts: DataFrame) -> DataFrame:
    """Facts to scored facts; the merged ones are written once, since conflicts and scores both read them."""
    merged = stored(deduplicate(facts), "merged-facts")
    return scored(merged, conflicts(merged))


def coverage(facts: DataFrame) -> DataFrame:
    """The 30 coverage fields of each site from scored facts."""
    fields = F.create_map(*(x for c in sorted({c for cs in K.COVERAGE.values() for c in cs}) for x in (F.lit(c), F.array(*(F.lit(f) for f, cs in K.COVERAGE.items() if c in cs)))))
    each = facts.select("site", F.explode(F.element_at(fields, F.col("category"))).alias("field"), "score", "n_urls", "conflict")
    out = each.groupBy("site", "field").agg(F.avg("score").alias("mean"), F.sum("n_urls").alias("urls"), F.count("*").alias("n"), F.bool_or("conflict").alias("conflict"))
    score = F.col("mean") * 0.72 + F.least(F.lit(18), F.col("urls") * 6) + F.least(F.lit(10), F.col("n") * 2) - F.when(F.col("conflict"), 18).otherwise(0)
    return out.select("site", "field", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("long").alias("coverage"))


def overall(fields: DataFrame) -> DataFrame:
    """X11c, X11d: overall coverage of each site and its core fields below 45."""
    core = [F.coalesce(F.max(F.when(F.col("field") == f, F.col("coverage"))), F.lit(0)) for f in K.CORE_FIELDS]
    total = sum(core[1:], core[0])
    missing = F.array_join(F.array_compact(F.array(*(F.when(c < 45, f) for c, f in zip(core, K.CORE_FIELDS, strict=True)))), ",")
    return fields.groupBy("site").agg(F.round(total / len(core) * 0.55 + F.sum("coverage") / len(K.COVERAGE) * 0.45).cast("long").alias("overall"), missing.alias("missing"))


def faqs(blocks: DataFrame) -> DataFrame:
    """X11e, W6: questions with the answers among the four blocks after them."""
    frame = W.partitionBy("page_id").orderBy("ordinal").rowsBetween(1, 4)
    ahead = F.collect_list(F.struct("type", "text")).over(frame)
    asks = F.col("text").rlike(r"\?$")
    question = (F.col("type") == "faq_question") | (asks & ((F.col("page_type") == "faq") | (F.col("type") == "heading")))
    none = F.struct(F.array().cast("array<string>").alias("said"), F.lit(False).alias("over"))

    def step(acc: Column, b: Column) -> Column:
        stops = acc["over"] | (b["type"] == "faq_question") | ((b["type"] == "heading") & b["text"].rlike(r"\?$"))
        said = F.when(~stops & b["type"].isin("faq_answer", "paragraph", "list_item"), F.concat(acc["said"], F.array(b["text"]))).otherwise(acc["said"])
        return F.struct(said.alias("said"), (stops | ((b["type"] != "faq_answer") & (F.size(said) >= 2))).alias("over"))

    own = blocks.withColumn("ahead", ahead).where(question).withColumn("said", F.aggregate("ahead", none, step)["said"])
    own = own.withColumn("answer", T.clean(F.array_join("said", " "))).where("answer <> ''")
    many = F.size("said") >= 2
    faq_id = T.stable_id("faq", F.concat_ws("\x00", F.lower("text"), F.lower("answer")))
    out = own.select("site", faq_id.alias("faq_id"), "page_id", "ordinal", F.col("text").alias("question"), "answer", F.when(many, 84).otherwise(70).alias("score"), F.when(many, "high").otherwise("medium").alias("confidence"))
    first = F.row_number().over(W.partitionBy("site", "faq_id").orderBy("page_id", "ordinal"))
    return out.withColumn("_n", first).where("_n = 1").drop("_n", "ordinal")

import json
import random

import pytest

from loamspark.operators import structured as O


def walk(value, depth=0):
    """The objects of a document by plain recursion."""
    if isinstance(value, dict):
        yield value
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        if isinstance(v, (dict, list)):
            yield from walk(v, depth + 1)


def document(rng, depth=0):
    kinds = ["Product", "Question", "Answer", "Thing", "Offer", ["Bakery", "Thing"], None, 7, "OpeningHoursSpecification", "AggregateRating"]
    value = lambda: rng.choice(["a  text", "N/A", "", 3, 2.0, 2.5, True, None, ["x", None, "y"], {"name": "inner"}, {"@id": "#0"}, "https://a.example/p", "https://b.example", "ftp://no"])
    keys = [*{k for _, keys in O.LINES for k in keys.split()}, "name", "@id", "other"]
    own = {"@type": rng.choice(kinds)} | {k: value() for k in rng.sample(sorted(keys), 6)}
    if rng.random() < 0.5:
        own["@id"] = f"#{rng.randrange(3)}"
    if depth < 4:
        own |= {rng.choice(["child", "offers", "acceptedAnswer", "@graph"]): rng.choice([document(rng, depth + 1), [document(rng, depth + 1), "x", [document(rng, depth + 1)]]]) for _ in range(rng.randint(0, 2))}
    return own


@pytest.mark.parametrize("seed", range(20))
def test_entities_equal_a_plain_walk(seed):
    rng = random.Random(seed)
    x = rng.choice([document(rng), [document(rng), document(rng)]])
    assert list(O.entities_of(x, O.Limits())) == list(walk(x))
    named = {}
    for e in walk(x):
        if isinstance(e.get("@id"), str) and e["@id"].strip():
            named.setdefault(e["@id"].strip(), e)
    want = [f"{a}: {v}" for e in walk(x) for a, v in O.entity_lines(e, named) if v and v.lower() not in ("n/a", "null", "undefined", "unknown")]
    assert O.lines_of([json.dumps(x)], O.Limits())[0] == want


def page(*blocks, kind='type="application/ld+json"'):
    return "<body>" + "".join(f"<script {kind}>{b}</script >" for b in blocks) + "</body>"


def facts(spark, html, limits=O.Limits()):
    rows, counts = O.json_ld(spark.createDataFrame([(1, html)], "page_id long, html string"), limits)
    found = counts.collect()
    return [r["line"] for r in rows.orderBy("nth").collect()], tuple(found[0])[1:4] if found else None


def test_graph_references_and_repeats(spark):
    graph = {"@graph": [{"@id": "a", "@type": "Answer", "text": "Yes!"}, {"@type": "Question", "name": "Open?", "acceptedAnswer": [{"@id": "a"}, {"text": "No"}]}]}
    lines, counts = facts(spark, page(json.dumps(graph), '{"@type": "Store", "name": "Shop", "address": {"streetAddress": "1 Way", "postalCode": 7}, "sameAs": ["https://x.example", "no"]}'))
    assert lines == ["FAQ answer: Yes!", "Business name: Open?", "FAQ question: Open?", "FAQ answer: No", "Business name: Shop", "Address: 1 Way, 7", "External profile: https://x.example/"]
    assert counts == (2, 0, 3)


def test_cycles_broken_and_other_scripts(spark):
    a = {"@id": "a", "@type": "Product", "name": "A", "brand": {"@id": "b"}}
    b = {"@id": "b", "@type": "Organization", "name": "B", "parentOrganization": {"@id": "a"}}
    lines, counts = facts(spark, page("{no", json.dumps([a, b]), "[" * 100_000, kind="type='application/LD+JSON' id=x"))
    assert lines == ["Product name: A", "Brand: b", "Business name: B", "Parent organization: a"] and counts == (3, 2, 2)
    assert facts(spark, page("{}", kind="")) == ([], None)
    assert facts(spark, None) == ([], None)


def test_limits_and_depth(spark):
    nested = {"@type": "Product", "name": "p0"}
    for i in range(1, 200):
        nested = {"@type": "Product", "name": f"p{i}", "x": [nested]}
    assert len(facts(spark, page(json.dumps(nested)))[0]) == 200
    assert facts(spark, page(json.dumps(nested)), O.Limits(depth=8))[0] == [f"Product name: p{199 - i}" for i in range(5)]
    assert len(facts(spark, page(json.dumps(nested)), O.Limits(items=50, facts=7))[0]) == 7


def test_relations_without_urls(spark):
    rows = [(1, "https://a.example/x", '<link rel=canonical href=""><link href="mailto:x" rel="alternate"><link>'), (2, "https://a.example/x", None), (3, None, "<link rel='canonical' href='/y'>")]
    canonical, alternates = O.link_relations(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert canonical.where("page_id < 3").collect() == [] and [(r["page_id"], r["url"]) for r in alternates.collect()] == [(1, None)]


def test_a_small_file_is_dealt_to_all_cores(spark):
    from loamspark.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.part.rdd.getNumPartitions() < 8 <= t.spread("part").rdd.getNumPartitions()
    assert t.spread("part").exceptAll(t.part).isEmpty() and t.spread("part").count() == t.part.count()

import pytest
from pyspark.sql import Row

from loamspark.operators import concepts as O

LONG = "Very Long Name of a Large Product Line Nine"


def related(spark, title, value, excerpts, target=LONG):
    base = {"score": 70, "provenance": "website", "source": "d", "explicit": True, "lanes": ["commercial"]}
    facts = spark.createDataFrame([
        Row(fact_id=1, category="pricing_plan", title=title, value=value, topic_key="pricing_plan:gold_plan", excerpts=excerpts, **base),
        Row(fact_id=2, category="product", title=target, value="A thing.", topic_key="product:thing", excerpts=["about it"], **base),
    ])
    found = spark.createDataFrame([("pricing_plan:gold_plan", "Gold Plan"), ("product:thing", target)], "topic_key string, name string")
    none = spark.createDataFrame([], "topic_key string")
    return {(r["relation"], r["source"], r["target"]) for r in O.relationships(facts, found, none).collect()}


EDGE = {("includes", "pricing_plan:gold_plan", "product:thing")}


@pytest.mark.parametrize(("title", "value", "excerpts"), [
    ("Gold Plan", f"The gold  plan includes the {LONG}.", ["nothing"]),
    (f"Gold plan includes {LONG.upper()}", "Nothing.", ["nothing"]),
    ("Gold Plan", "Nothing.", ["other", f"Our gold plan features, among others, {LONG.lower()} today"]),
])
def test_names_of_any_length_in_any_statement(spark, title, value, excerpts):
    assert related(spark, title, value, excerpts) == EDGE


@pytest.mark.parametrize("value", [f"{LONG} includes the gold plan.", f"Gold plan and {LONG}.", f"Gold plans includes {LONG}s.", "Gold plan includes it." + " x" * 100 + LONG])
def test_what_is_no_statement(spark, value):
    assert related(spark, "Gold Plan", value, []) == set()


def test_names_with_symbols(spark):
    assert related(spark, "Gold Plan", "Gold plan includes C++ (v2.0) tools", [], "c++") == EDGE

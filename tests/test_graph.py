import random

import pytest

from loamspark.operators import graph as O


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng, edges, parent = random.Random(seed), [], {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for project in range(4):
        n = rng.choice([3, 40, 300])
        edges += [(project, rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
        edges += [(project, 1000 + i, 1001 + i) for i in range(rng.choice([0, 90]))]  # a long chain
    for p, a, b in edges:
        if a != b:
            low, high = sorted((find((p, a)), find((p, b))))
            parent[high] = low
    found = {(r["project"], r["id"]): r["root"] for r in O.components(spark.createDataFrame(edges, "project long, a long, b long")).collect()}
    assert found == {x: find(x)[1] for x in parent}


def test_chains_mark_cycles_by_project(spark):
    rows = [(1, i, i - 1) for i in range(1, 50)] + [(2, 1, 2), (2, 2, 3), (2, 3, 2), (2, 9, 8), (3, 5, 5)]
    found = {(r["project"], r["src"]): (r["dst"], r["cyclic"]) for r in O.chains(spark.createDataFrame(rows, "project long, src long, dst long")).collect()}
    assert all(found[1, i] == (0, False) for i in range(1, 50))
    assert [found[2, i][1] for i in (1, 2, 3)] == [True] * 3 and found[2, 9] == (8, False) and found[3, 5][1]


def test_nothing_is_connected(spark):
    none = spark.createDataFrame([], "project long, a long, b long")
    assert O.components(none).collect() == [] and O.chains(none.toDF("project", "src", "dst")).collect() == []


def test_projects_with_cycles_of_predecessors_are_refused(spark):
    from loamspark.operators import knowledge as K

    kind = "project long, id long, entity long, state string, value string, predecessor long"
    rows = [(1, 1, 1, "archived", "a", 2), (1, 2, 1, "archived", "a", 1), (2, 1, 1, "archived", "a", None), (2, 2, 1, "approved", "b", 1), (3, 1, 7, "approved", "c", None), (3, 2, 8, "approved", "d", None)]
    a = spark.createDataFrame(rows, kind)
    none = spark.createDataFrame([], "project long, resolved boolean")
    assert {(r["project"], r["code"]) for r in K.refusals(a, none).collect()} == {(1, "assistant_projection_unresolved_revision_authority")}
    entities = a.selectExpr("project", "entity", "'t' as type", "'n' as name").distinct()
    merges = spark.createDataFrame([(7, 6), (6, 7)], "src long, dst long")
    assert sorted((r["project"], r["id"]) for r in K.projection(a, entities, merges, none).collect()) == [(2, 2), (3, 2)]

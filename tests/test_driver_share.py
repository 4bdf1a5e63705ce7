"""What grows with the input is joined by shuffles: none of it is broadcast through the driver."""

from loamspark.operators import graph, memory


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_chains_components_and_merges_broadcast_nothing(spark):
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 2)], "project long, a long, b long")
    entities = spark.createDataFrame([(p, i, "t", True) for p in (1, 2) for i in (1, 2, 3)], "project long, id long, type string, active boolean")
    keys = spark.createDataFrame([(1, 3, "email", "x")], "project long, entity long, type string, value string")
    redirects = links.selectExpr("project", "b as src", "a as dst").where("project = 1")
    ends = graph.chains(redirects)
    assert broadcasts(ends) == 0
    assert {(r.src, r.dst) for r in ends.collect()} == {(2, 1), (3, 1)}
    done, refused = memory.merges(links, entities, keys)
    assert broadcasts(done) == 0 and broadcasts(refused) == 0
    assert {(r.project, r.id, r.survivor) for r in done.collect()} == {(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 2, 1)}

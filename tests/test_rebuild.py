"""A rebuild reads its plan from one stored table, however many tables meet it."""

from loamspark.operators import memory
from loamspark.plans import memory as stand_ins
from loamspark.plans.registry import Tables


def test_plan_is_computed_once(spark):
    inputs = stand_ins._inputs(Tables(spark, "/root/testdata/sf0.001"))
    plan = spark.createDataFrame([("1", "rebuild"), ("2", "keep"), ("3", "drop")], "project string, action string").where("project <> 'a marked plan'")
    out = memory.rebuild(memory.build(inputs), inputs, plan)["assertions"]
    assert "a marked plan" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.project for r in out.select("project").distinct().collect()} == {"1", "2"}

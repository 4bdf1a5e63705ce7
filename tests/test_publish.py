"""A publication stores what its checks read again: their plans read tables, not the work before."""

from loamspark.operators import governance


def test_checks_read_stored_tables(spark):
    shape = "project string, id string, status string"
    before = {n: spark.createDataFrame([("p", "1", "other"), ("q", "4", "a")], shape) for n in ("reviews", "trusted")}
    staged = {n: spark.createDataFrame([("p", "1", "a"), ("p", "2", "a"), ("q", "3", "a"), ("q", "4", "a")], shape).where("id <> 'a marked row'") for n in ("reviews", "trusted")}
    after, held = governance.publish(before, staged)
    assert all("a marked row" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (*after.values(), held))
    assert [r.project for r in held.collect()] == ["p"]
    assert sorted(r.id for r in after["trusted"].collect()) == ["1", "3", "4"]
    assert governance.mismatches(after, staged, held).isEmpty()

"""Streams against the batch operators, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from loamspark.operators import conversation, events
from loamspark.sources import readers, writers
from loamspark.streaming import events as streams

DATA = "/root/testdata/sf0.001"
KIND = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture
def stream(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props").orderBy("ts", "event_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    yield streams.read(spark, str(tmp_path / "in"), KIND), spark.read.schema(KIND).parquet(str(tmp_path / "in")), tmp_path


def collected(spark, df, path, mode):
    name = f"out_{path.name.replace('-', '_')}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{path}/checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_progress(spark, stream):
    live, rows, path = stream
    rank, done = F.length("event_type"), F.col("value")
    assert sorted(collected(spark, streams.progress(live, "user_id", rank, done), path, "complete")) == sorted(map(tuple, events.progress(rows, "user_id", rank, done).collect()))


def test_deduplicated(spark, stream):
    live, rows, path = stream
    got = collected(spark, streams.deduplicated(live, ["user_id", "event_type"], late="3650 days").select("user_id", "event_type"), path, "append")
    assert sorted(got) == sorted(map(tuple, rows.select("user_id", "event_type").distinct().collect()))


def test_sliding_counts(spark, stream):
    live, rows, path = stream
    got = collected(spark, streams.counts(live, "user_id"), path, "append")
    want = rows.groupBy("user_id", F.window("ts", "1 hour", "10 minutes")).agg(F.count("*").alias("n")).select("user_id", "window.start", "window.end", "n")
    assert got and set(got) <= set(map(tuple, want.collect()))


def test_changes(spark, stream):
    live, rows, path = stream
    got = collected(spark, streams.changes(live, "user_id", "event_type").select("key", "signature", "previous"), path, "append")
    want = events.changes(rows, "user_id", ["ts", "event_type"], "event_type").select(F.col("user_id").cast("string"), "event_type", "previous")
    assert sorted(got, key=str) == sorted(map(tuple, want.collect()), key=str)


def test_invalid_lines_raise_or_are_dropped(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"id": 1, "name": "x"}\n\nnot json\n[1]\n{"id": "no number"}\n{"id": 2}\n')
    rows = readers.ndjson(spark, f"file://{tmp_path}", "id long, name string", "drop").collect()
    assert sorted((r["id"], r["name"]) for r in rows) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="invalid event"):
        readers.ndjson(spark, f"file://{tmp_path}", "id long, name string").collect()


def test_sitemap(spark):
    doc = "<urlset><url><loc> https://a.example/x?a=1&amp;b=2 </loc></url><url><loc><![CDATA[https://a.example/y]]></loc></url></urlset>"
    rows = spark.createDataFrame([(1, doc), (2, "<sitemapindex><sitemap><loc>https://a.example/s.xml</loc></sitemap></sitemapindex>"), (3, None), (4, "")], "id long, xml string")
    got = {(r["id"], r["kind"], r["url"]) for r in readers.sitemap(rows, "xml", ["id"]).collect()}
    assert got == {(1, "page", "https://a.example/x?a=1&b=2"), (1, "page", "https://a.example/y"), (2, "index", "https://a.example/s.xml")}


def test_written_json_reads_back(spark, tmp_path):
    writers.write_ndjson(spark.createDataFrame([(1, "é")], "id long, name string"), f"file://{tmp_path}/out")
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"id": 1, "name": "é"}]
    assert [tuple(r) for r in readers.table(spark, f"file://{tmp_path}/out", "json", "id long, name string").collect()] == [(1, "é")]


def test_memory_of_a_conversation(spark):
    said = ["I need help about opening hours.", "Let us pause", "start over", "I prefer mornings. What about delivery for today?", "service is Gold Care", "", None]
    rows = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(said)] + [(1, 9, "assistant", "reset"), (2, 0, "user", "hold on")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r.asDict() for r in conversation.memory(rows).collect()}
    assert got[1] == {"conv_id": 1, "status": "active", "subject": "delivery for today", "goal": None, "service": "Gold Care", "n_follow_ups": 1, "n_clarifications": 0, "n_context": 1, "n_preferences": 1, "n_details": 2}
    assert got[2]["status"] == "paused"

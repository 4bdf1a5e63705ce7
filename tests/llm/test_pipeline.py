import corpus_pipeline
from loamspark.llm import near_dedup
from loamspark.llm.common import read_table

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_what_is_clean(spark):
    docs = read_table(spark, DATA, "documents")
    first, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        own = stage(spark, docs, DATA)
        seen.append((name, own.count()))
        assert own.columns[: len(first.columns)] == first.columns and (own.columns == first.columns) == (name != "source mixing")
        assert own.count() <= docs.count()
        docs = own
    counts = dict(seen)
    assert counts["MinHash near-dedup"] == near_dedup.classes(spark, first).select("class_id").distinct().count()
    assert counts["secret scans"] == counts["benchmark decontamination"] == counts["source mixing"]
    rows = corpus_pipeline.run(spark, DATA).select("doc_id", "slot", "place").collect()
    assert len(rows) == len(set(rows)) == counts["source mixing"] and len({r["doc_id"] for r in rows}) == len(rows)


def test_every_stage_on_odd_rows(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, extra columns with names the stages use, and no rows."""
    read = read_table(spark, DATA, "documents")
    good = read.where("length(text) > 400").orderBy("doc_id").limit(1).collect()[0]
    text = good["text"]
    rows = [
        (None, text, "en", "a", 1), (1, None, None, None, 0), (2, "", "en", None, 0), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (3, text, "en", "a", 1),
        (4, " ".join([text] * 200), "en", "b", 2), (5, "password: hunter2secret99 " + text[:300], "en", "b", 2), (None, "12345 67890", "xx", "b", 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "7 AS slot", "8 AS place", "'k' AS key", "'h' AS hash", "9 AS _hash", "1 AS class_id", "2 AS uid", "3 AS row", "4 AS n", "5 AS root")
    fitted = docs.unionByName(read.where("crc32(cast(doc_id AS string)) % 3 <> 1").limit(60), allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        own = stage(spark, fitted, DATA)
        n, kept = own.count(), own.where("key = 'k'")
        assert n <= fitted.count() and set(own.columns) == set(docs.columns)
        if name == "language ID":
            assert kept.where("doc_id IN (1, 2) OR text = '12345 67890'").count() == 0 and kept.where("doc_id = 3").count() == 3
        elif name == "MinHash near-dedup":
            # One row of the equal texts stays, one of each text without a word, and the others.
            assert own.where(own["text"] == text).count() == 1 and kept.where("doc_id IN (1, 2, 4, 5)").count() == 4
        elif name == "benchmark decontamination":
            assert kept.where("doc_id IN (1, 2)").count() == 2
        else:
            assert n == fitted.count()
            if name == "secret scans":
                assert kept.where("text LIKE '%hunter2secret99%'").count() == 0 and kept.where("doc_id = 1 AND text IS NULL").count() == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name

from loamspark.functions import text as T
from loamspark.operators import pages as O
from pyspark.sql import functions as F


def test_protected_texts_by_their_three_kinds(spark):
    texts = ["Opening HOURS", "reopened", "Contacts", "contact", "e-mail", "Email_us", "a@b.co", "a @ b.co", "tel 0123 456 789", "+1 (2) 3-4", "12345678", "ÖPEN open", "İopen", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(O.protected(F.col("text")).alias("got"), T.matches(F.col("text"), O.PROTECTED).alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and {r["got"] for r in rows} == {True, False, None}


def test_runs_of_white_space(spark):
    texts = ["a b", "a  b", "a\tb", "a b", " a 　 b\n", "\n", "a\x00 b", "a ", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.clean(F.col("text")).alias("got"), F.trim(F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\x00"), F.lit("")), T.SPACES + "+", " ")).alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and rows[3]["got"] == "a b"


def test_boilerplate_computes_the_text_of_a_block_once(spark):
    """A filter on protected texts moved below the block's own text and computed that for each of its patterns."""
    made = spark.createDataFrame([("s", i, t) for i in range(3) for t in (" Same  line ", "call 0123 456 789")], "site string, page_id long, raw string")
    found = O.boilerplate(made.select("site", "page_id", T.clean(F.col("raw")).alias("text")))
    assert [(r["site"], r["pages"]) for r in found.collect()] == [("s", 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.RUNS) == 2  # of the block, and of its key

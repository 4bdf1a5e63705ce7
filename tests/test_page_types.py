from pyspark.sql import functions as F

from loamspark.functions import text as T
from loamspark.operators import facts as O


def test_both_white_space_patterns_agree_on_every_character(spark):
    chars = spark.range(65536).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    hits = chars.select(F.col("c").rlike(f"^{T.SPACE}$").alias("a"), F.col("c").rlike(f"^{T.SPACES}$").alias("b"))
    found = hits.agg(F.count_if("a").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("other")).first()
    assert tuple(found) == (25, 0)


def test_a_page_type_holds_until_its_heading_url_or_declaration_changes(spark):
    rows = [("p", 0, "https://a.example/x", None, None), ("p", 1, "https://a.example/x", None, "Pricing plans"), ("p", 2, "https://a.example/x", None, "Pricing plans"), ("p", 3, "https://a.example/x", "homepage", "Pricing plans"),
            ("p", 4, "https://a.example/", None, ""), ("p", 5, "https://a.example/about", None, ""), ("q", 0, "https://a.example/about", "faq", "")]
    blocks = spark.createDataFrame(rows, "page_id string, ordinal int, url string, declared string, heading string")
    got = [r["page_type"] for r in O.with_page_type(blocks).orderBy("page_id", "ordinal").collect()]
    assert got == ["other", "pricing", "pricing", "home", "home", "about", "faq"]

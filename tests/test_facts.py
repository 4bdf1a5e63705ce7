"""The fact engine reads few sentences closely: what its first look leaves out, no rule would have taken."""

from itertools import islice, product
from re import _constants as C
from re import _parser

from pyspark.sql import functions as F

from loamspark.functions import rules as K
from loamspark.operators import facts as O
from loamspark.plans.facts import _blocks
from loamspark.plans.registry import Tables


def texts(tree):
    """Texts that a parsed pattern matches: each branch, and repeats at their least and at one."""
    parts = []
    for op, arg in tree:
        if op is C.LITERAL:
            parts.append([chr(arg)])
        elif op is C.ANY:
            parts.append(["x"])
        elif op is C.IN:
            kind, x = arg[0]
            parts.append([chr(x) if kind is C.LITERAL else chr(x[0]) if kind is C.RANGE else {C.CATEGORY_DIGIT: "7", C.CATEGORY_WORD: "w", C.CATEGORY_SPACE: " "}[x]])
        elif op is C.SUBPATTERN:
            parts.append(list(texts(arg[3])))
        elif op is C.BRANCH:
            parts.append([t for branch in arg[1] for t in texts(branch)])
        elif op is C.MAX_REPEAT:
            least, most, inner = arg
            parts.append([t * n for n in {least, min(max(least, 1), most)} for t in texts(inner)])
        else:
            assert op is C.AT
    return ("".join(p) for p in islice(product(*parts), 20000))


def test_what_any_rule_looks_for_is_looked_for_first(spark):
    own = sorted({(r.title, f"{lead}{t}{tail}") for r in K.RULES for t in texts(_parser.parse(r.evidence)) for lead, tail in (("", ""), ("É ", "."), ("(", "é"))})
    said = spark.createDataFrame(own, "rule string, s string").withColumn("fires", F.lit(False))
    for r in K.RULES:
        said = said.withColumn("fires", F.col("fires") | O.T.matches(F.col("s"), r.evidence, r.ignore_case))
    assert len(own) > 1000 and said.where("fires").select("rule").distinct().count() == len({r.title for r in K.RULES})
    assert said.where(F.col("fires") & ~O.may_hit(F.col("s"))).count() == 0
    wide = said.withColumn("s", F.replace("s", F.lit(" "), F.lit(" \t")))
    assert wide.where(F.col("fires") & ~O.may_hit(F.col("s"))).count() == 0


def test_sentences_without_a_rules_word_meet_no_rule(spark):
    text = "Nothing of note is here. We  offer care of gardens. Nothing more either. The pl\0an is for all."
    blocks = spark.createDataFrame([(1, 0, "paragraph", text), (2, 0, "paragraph", "Nothing of note is here."), (3, 0, "heading", "We offer care.")], "page_id long, ordinal int, type string, text string")
    none = F.lit(None).cast("string")
    found = O.said(blocks.withColumns({"heading": none, "previous_type": none, "previous_text": none}))
    assert {(r.page_id, r.sentence) for r in found.collect()} == {(1, "We offer care of gardens."), (1, "The plan is for all.")}


def test_documents_of_one_file_are_cut_by_many_tasks_in_one_shuffle(spark):
    blocks = _blocks(Tables(spark, "/root/testdata/sf0.001"))
    plan = O.with_page_type(blocks.withColumn("heading", F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate posexplode") < plan.index("Exchange")


def test_repeated_texts_are_dropped_and_others_kept(spark):
    rows = [("s", f"https://s/{p}", p, None, i, t) for p in (1, 2) for i, t in enumerate(("Follow us on X!", "follow\0 us on x", "Our newsletter: email us", f"Newsletter {p}", "Menu", "The menu of today"))]
    blocks = spark.createDataFrame(rows, "site string, url string, page_id long, declared string, ordinal int, text string").withColumns({"type": F.lit("paragraph"), "structured": F.lit(False)})
    found = {(r.page_id, r.text) for r in O.normalise(blocks).collect()}
    assert found == {(p, t) for p in (1, 2) for t in ("follow\0 us on x", "Our newsletter: email us", f"Newsletter {p}", "The menu of today")}

import hashlib
import re
import time

from loamspark.llm import queries
from loamspark.llm import secret_scan as S
from loamspark.llm.common import read_table

DATA = "/root/testdata/sf0.001"
LETTERS = {"password", "passwd", "secret", "token", "api_?key"}
WORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in sorted(LETTERS, key=len, reverse=True))
PLAIN = (("assign", rf"""({WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))


def brute(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, p, g, least) in enumerate(PLAIN) for m in re.finditer(p, text or "") if len(m.group(g)) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_base_spans_equal_plain_matching(spark):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, DATA, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op5_secrets(spark, DATA).collect()}
    assert set(got) == set(texts) and all(got[i]["base_sha256"] == digest(brute(t)) for i, t in texts.items())


def test_made_texts(spark):
    texts = [
        None, "", "Password = 'abcdef1' token:short=1 API_KEY=\"Zz9/+=._-\" secret : x", "é𝒳 token=AKIA" + "A1" * 10, "a" * 23 + " " + "b" * 24 + "g" + "0" * 30,
        "tokentoken=abcdefgh=ijk token==abcdefg", "passwd\n=abcdefgh", "see ghp_R7x9KqL2mNv8TzW4yB1cD6fH3jP5sA0e now", "order 4785380592391139 paid", "call get_user_name_by_identifier_2 or /usr/local/share/python3/site-packages", "apikey=1234567",
    ]
    rows = [(i, t, [], "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base array<int>, run string")
    got = {r["doc_id"]: r for r in _scan(spark, docs)}
    for i, t in enumerate(texts):
        assert got[i]["b"] == brute(t), t
    assert got[7]["s"] == "markov:4:40" and not got[8]["s"] and not got[9]["s"]
    clean = S.redact(spark, docs)
    assert clean.columns == docs.columns
    by = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by[0] is None and by[1] == "" and by[8] == texts[8] and by[7] == "see [SECRET] now" and by[10] == "[SECRET]"


def _scan(spark, docs):
    from pyspark.sql import functions as F

    return S.scan(spark, docs).select("doc_id", S.as_text(F.col("base")).alias("b"), S.as_text(F.col("spans")).alias("s")).collect()


def test_long_text_and_empty_table(spark):
    text = ("word " * 50_000) + "token=abcdefghij " + "x9" * 40_000
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    began = time.time()
    got = _scan(spark, docs)
    assert [r["b"] for r in got] == [brute(text)] * 2 and time.time() - began < 60
    assert _scan(spark, docs.limit(0)) == [] and S.redact(spark, docs.limit(0)).count() == 0

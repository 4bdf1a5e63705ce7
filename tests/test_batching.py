import random

import pytest
from pyspark.sql import functions as F

from loamspark.operators import batching as O

KIND = "project long, page long, source string, url string, type string, title string, text string"


def render(p, text, k, n):
    lines = [f"PAGE {p[1]}", f"SOURCE ID: {p[2]}", f"URL: {p[3]}", f"TYPE: {p[4]}", f"TITLE: {p[5]}" if p[5] else "", f"CHUNK: {k} OF {n}", "CONTENT:", text]
    return "\n".join(x for x in lines if x)


def plain(pages, most):
    """Each project's units and batches by a loop: the longest chunk that fits, by trying."""
    out = []
    for project in sorted({p[0] for p in pages}):
        current, batch = [], 1
        for p in sorted(x for x in pages if x[0] == project):
            text = p[6] or ""
            chunks = [text]
            if len(render(p, text, 1, 1)) > most:
                chunks, at = [], 0
                while at < len(text):
                    n = max(i for i in range(len(text) - at + 1) if len(render(p, text[at : at + i], len(chunks) + 1, len(text))) <= most)
                    chunks.append(text[at : at + n])
                    at += n
            for k, x in enumerate(chunks, 1):
                unit = render(p, x, k, len(chunks))
                if len(O.BETWEEN.join([*current, unit])) > most:
                    current, batch = [], batch + 1
                current.append(unit)
                out.append((project, p[1], k, len(chunks), x, batch))
    return sorted(out)


@pytest.mark.parametrize("most", [120, 300, 5000])
def test_equals_a_loop(spark, most):
    rng, pages = random.Random(most), []
    for project in range(5):
        for page in range(rng.choice([1, 3, 60])):
            pages.append((project, page, f"s{page}", "u", "t", rng.choice(["", "A title"]), rng.choice([None, "", "x" * rng.randint(1, 60), "yé🙂" * rng.randint(1, 700 if page % 9 == 0 else 20)])))
    found = O.batches(spark.createDataFrame(pages, KIND).repartition(5), most)
    rows = sorted((r["project"], r["page"], r["chunk"], r["chunks"], r["text"], r["batch"]) for r in found.collect())
    assert rows == plain(pages, most)
    assert all(r["fits"] for r in found.select("fits").distinct().collect())


def test_page_that_cannot_fit(spark):
    pages = [(1, 1, "s" * 200, "u", "t", "", "text"), (1, 2, "s", "u", "t", "", "text")]
    rows = {r["page"]: (r["fits"], r["batch"]) for r in O.batches(spark.createDataFrame(pages, KIND), 120).collect()}
    assert rows == {1: (False, None), 2: (True, 1)}


def test_nothing(spark):
    assert O.batches(spark.createDataFrame([], KIND)).collect() == []


def test_halves_lose_nothing(spark):
    rng = random.Random(1)
    pages = [(p, k, "s", "u", "t", "", "".join(rng.choice("ab🙂é") for _ in range(rng.randint(0, 90)))) for p in range(3) for k in range(12)]
    sent = O.batches(spark.createDataFrame(pages, KIND), 400)
    fails = lambda t: t.where((F.col("size") > 90) & (F.col("project") < 2))
    found = O.halved(sent.select("project", "page", "batch", "place", "chunk", "chunks", "text", "size"), fails).collect()
    back = {}
    for r in sorted(found, key=lambda r: (r["project"], r["page"], r["chunk"] / r["chunks"])):
        back[r["project"], r["page"]] = back.get((r["project"], r["page"]), "") + r["text"]
    assert back == {(p[0], p[1]): p[6] for p in pages}
    total = {}
    for r in found:
        total.setdefault((r["project"], r["batch"]), []).append(r)
    for (project, _), rows in total.items():
        size = sum(r["size"] for r in rows) + len(O.BETWEEN) * (len(rows) - 1)
        assert project == 2 or size <= 90 or rows[0]["refused"]
    assert not any(r["refused"] for r in found)

import random

from loamspark.llm import decontamination as D


def plain(item, text):
    """Least edit distance of the item from any stretch of the text, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_distance_equals_the_full_table():
    rng = random.Random(3)
    for _ in range(200):
        item, text = ("".join(rng.choices("abc", k=rng.randint(1, n))) for n in (20, 60))
        assert D.distance(item, text, 100) == plain(item, text)


def test_all_occurrences_within_the_budget_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(12)]
    docs, p = [], D.Params()
    for d in range(60):
        text = " ".join(word() for _ in range(60))
        if d % 2:
            own = list(items[d % 12][1])
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice(["", "z", own[at] + "y"])
            text += " " + "".join(own).upper() + "\n tail of it"
        docs.append((d, text))
    want = set()
    for d, t in docs:
        for i, x in items:
            k = plain(D.normalise(x), D.normalise(t))
            if k <= D.budget(len(D.normalise(x)), p):
                want.add((d, i, k))
    got = D.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert want and {tuple(r) for r in got.select("doc_id", "item_id", "distance").collect()} == want


def test_blocks_of_items_give_the_same(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"alpha beta gamma delta epsilon {x}") for i, x in enumerate(["zeta", "zetb", "quite another"])], "item_id long, text string")
    one, many = (D.contaminated(spark, docs, items, D.Params(block=b)).collect() for b in (10**6, 20))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and {r["item_id"] for r in one} == {0, 1}


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps", 1, 2), (1, "the quick brown fox jumps", 1, 2), (2, None, 1, 2), (3, "", 1, 2), (None, "the quick brown fox jumps", 1, 2)], "doc_id long, text string, item_id long, distance long")
    items = spark.createDataFrame([(7, "quick brown  FOX", 0), (8, None, 0), (9, " ", 0), (None, "quick", 0)], "item_id long, text string, doc_id long")
    got = sorted(D.contaminated(spark, docs, items).collect(), key=str)
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 7), (None, 7)} and len(got) == 2
    kept = D.keep_clean(spark, docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(spark, docs, none).count() == 0 and D.keep_clean(spark, docs, none).count() == 5
    assert D.contaminated(spark, docs.limit(0), items).count() == 0

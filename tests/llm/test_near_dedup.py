from itertools import combinations

from loamspark.llm import near_dedup as N
from loamspark.llm.common import read_table

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def classes(spark, docs):
    return {r["doc_id"]: r["class_id"] for r in N.classes(spark, docs).collect()}


def test_links_of_all_pairs_are_found(spark):
    docs = read_table(spark, DATA, "documents")
    own = {r["doc_id"]: shingles(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    got = classes(spark, docs)
    assert set(got) == set(own)
    near = {(a, b) for a, b in combinations(own, 2) if len(own[a] & own[b]) >= 0.85 * len(own[a] | own[b]) > 0}
    assert near and all(got[a] == got[b] for a, b in near)
    far = {(a, b) for a, b in combinations(own, 2) if got[a] == got[b] and own[a] | own[b] and len(own[a] & own[b]) < 0.5 * len(own[a] | own[b])}
    assert not far


def test_large_groups_of_copies_and_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(300)] + [(300 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(150)] + [(900, "something else entirely here now")]
    got = classes(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {got[i] for i in range(450)} == {0} and got[900] == 900


def test_nulls_empty_long_repeated_rows_and_clashing_columns(spark):
    long = " ".join(f"n{i % 9973}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, long), (7, long + " end")]
    docs = spark.createDataFrame([(a, b, 0, "k", 1) for a, b in rows], "doc_id long, text string, n long, key string, class_id long")
    found = N.classes(spark, docs).collect()
    got = {r["doc_id"]: r["class_id"] for r in found}
    assert len(found) == len(rows)
    assert [got[i] for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 3, 4, 4, 6, 6]
    kept = N.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.classes(spark, empty).collect() == [] and N.keep_one(spark, empty).collect() == []


def test_a_pair_that_shares_one_band_with_a_pivot_unlike_both(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [base, [*base[:-1], "x"], *([f"{c}{i}" for i in range(100)] for c in "pqr")]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    p = N.Params()
    keys = [[1000 * i + band for band in range(p.bands)] for i in range(len(texts))]
    for i in (0, 1, 2):
        keys[i][0] = -1  # the only band that 0 and 1 share, with 2
    for i in (2, 3, 4):
        keys[i][5] = -2  # which makes 2 the pivot
    unique = spark.createDataFrame(list(enumerate(keys)), "doc_id long, keys array<long>")
    idf = spark.sparkContext.broadcast(N.word_idf(spark, docs, p))
    for part in (256, 1):
        got = N.links(spark, docs, unique, idf, N.Params(part=part, small=16 if part > 1 else 2), N.Scratch(spark, "test")).collect()
        assert [tuple(r) for r in got] == [(0, 1)]


def test_null_and_shared_ids_lose_no_text(spark):
    rows = [(None, "one text of its own here"), (None, ""), (1, "alpha beta gamma delta epsilon zeta"), (1, "north east south west up down"), (2, "north east south west up down"), (1, None), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.classes(spark, docs).collect()
    assert sorted(tuple(r) for r in found if r["doc_id"] == 2) == [(2, 1)] and len(found) == len(rows)
    kept = {tuple(r) for r in N.keep_one(spark, docs).collect()}
    assert kept == {rows[0], rows[1], rows[2], rows[3], rows[5]}


def test_a_bucket_of_unlike_texts_loses_no_link(spark):
    """A family of mutual similarity about 0.7 with near copies in it, all in one hot bucket, against all pairs by the same measure."""
    import random

    import numpy as np
    from loamspark.llm.kernels import words

    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    family = [[f"x{i}.{j}" if rng.random() < 0.035 else t for j, t in enumerate(base)] for i in range(60)]
    family += [[*t[:at], "new", *t[at + 1 :]] for t in rng.sample(family, 20) for at in (rng.randrange(150),)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(family)], "doc_id long, text string")
    unique = spark.createDataFrame([(i, [7] + [100 * i + k for k in range(11)]) for i in range(len(family))], "doc_id long, keys array<long>")
    p = N.Params(part=16)
    idf = spark.sparkContext.broadcast(N.word_idf(spark, docs, p))
    found = {tuple(r) for r in N.links(spark, docs, unique, idf, p, N.Scratch(spark, "test")).collect()}
    doc, h, weight = N.shingles(words([" ".join(t) for t in family]), idf.value, p.shingle)
    own = [(h[doc == i] >> np.uint64(32), weight[doc == i]) for i in range(len(family))]
    want = {(a, b) for a, b in combinations(range(len(family)), 2) if N.weighted_jaccard(*own[a], *own[b]) >= p.threshold}

    def component(links):
        least = list(range(len(family)))
        for _ in family:
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        return least

    assert 20 <= len(want) < 500 and found <= want and component(found) == component(want)


def test_a_pivot_with_many_near_copies_counts_only_its_frequent_differences(spark):
    """Each part of a group names a bounded number of differences, however many its members have; the frequent ones are all there."""
    import numpy as np

    own = [[10**6 * (i + 1) + j for j in range(20)] + [7, *([8] if i % 4 == 0 else [])] for i in range(256)]
    packed = [np.array(t, np.int64).tobytes() + np.ones(len(t)).tobytes() for t in own]
    rows = spark.createDataFrame([("p", i % 2, v) for i, v in enumerate(packed)], "pivot string, part int, differences binary")
    assert sorted(tuple(r) for r in N.frequent_differences(rows, 1 / 16).collect()) == [("p", 7, 256), ("p", 8, 64)]


def test_differences_of_one_member_only_meet_no_join(spark, monkeypatch):
    """Rows of frequent differences are joined to their counts; of the others only the shared ones are left, and no link is lost."""
    given, attach = [], N.attach

    def seen(rows, groups, key, count):
        given.append(sorted({r["group"] for r in rows.collect()}))
        return attach(rows, groups, key, count)

    monkeypatch.setattr(N, "attach", seen)
    own = [(100 * i + j, str(i), i < 2, False) for i in range(1, 9) for j in range(20)]  # each member's own
    shared = [(7, str(i), i < 2, True) for i in range(1, 9)] + [(8, str(i), i < 2, False) for i in (1, 5)] + [(9, str(i), False, False) for i in (4, 5)]
    linked = [(10, str(i), True, False) for i in (0, 1)]  # all linked with the pivot
    rows = spark.createDataFrame(own + shared + linked, "group long, doc_id string, linked boolean, often boolean")
    got = sorted(tuple(r) for r in N.sharing(rows, N.Scratch(spark, "test")).select("group", "doc_id", "linked", "n").collect())
    assert got == sorted([(7, str(i), i < 2, 8) for i in range(1, 9)] + [(8, "1", True, 2), (8, "5", False, 2), (9, "4", False, 2), (9, "5", False, 2)])
    assert given == [[7]]

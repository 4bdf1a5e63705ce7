import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from loamspark.llm import importance_resampling as R
from loamspark.llm import strings as S
from loamspark.llm.common import read_table

SMALL = R.Params(block=300, chunk=64, part=400, least_words=5, percent=30)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, p):
    """(doc_id, n_features, weight, score, rank) by a string for each feature."""
    bucket = lambda f: zlib.crc32(f.encode()) % p.buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000.0) / ((s[b] + 1) * (nt + 10000.0))))
    rows = []
    for i, text in docs:
        n, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((r for r in rows if r[4] >= p.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: p.percent * len(order) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def found(spark, docs, target, p):
    rows = R.resample(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), p)
    return sorted((tuple(r) for r in rows.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_equals_counting_every_feature(spark):
    rng = random.Random(5)
    words = ["the", "THE", "é", "日本", "x1", "a-b", "don't", "\x00", "_", "ÀB", "z" * 90, "\x7f", "\n", "{", "`k"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " - ", "one", "one two", "the " * 900, texts[3], texts[3]]
    docs = [(None if i in (7, 9) else i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (4, "other words for a known id here")]
    target = ["the é 日本", None, "", texts[11], texts[12] * 3]
    assert found(spark, docs, target, SMALL) == plain(docs, target, SMALL)


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, folder, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in read_table(spark, folder, "benchmark").collect()]
    assert found(spark, docs, target, R.Params()) == plain(docs, target, R.Params())


@pytest.mark.parametrize(("docs", "target"), [([], []), ([(1, "a b")], []), ([], ["a b"]), ([(1, None), (1, None)], [None])])
def test_little(spark, docs, target):
    p = R.Params(least_words=1, percent=100)
    assert found(spark, docs, target, p) == plain(docs, target, p)


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 8, "mine", -1) for i in range(20)], "doc_id long, text string, weight string, rank int")
    rows = R.drawn(spark, docs, spark.createDataFrame([("word3 word3",)], "text string"), SMALL).collect()
    assert len(rows) == 6 and {r["rank"] for r in rows} == set(range(1, 7)) and {r["weight"] for r in rows} == {"mine"}


def test_crc32_of_many_strings():
    rng = random.Random(1)
    values = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 30, 400]))) for _ in range(500)]
    array = pa.array([b"ahead", *values], pa.large_binary()).slice(1)
    assert S.crc32(array).tolist() == [zlib.crc32(v) for v in values]


def test_packed_features_come_back():
    w = S.words_of(["b a b c", "a b", "", "ä b c a b"])
    for dictionary, own in R.chunks(w, R.Params(chunk=5), False):
        packed = R._packed(dictionary, [(f.word, f.count) for f in own])
        for k, f in enumerate(own, 1):
            features, count = R._unpacked(packed, k)
            assert features.to_pylist() == R.strings(dictionary, f.word).to_pylist() and count.tolist() == f.count.tolist()


@pytest.mark.parametrize("followers", [64, 2])
def test_features_are_dealt_by_their_first_words(spark, followers):
    """A word's features lie in one part unless it starts very many; no count is lost or found twice either way."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "the", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(60))) for _ in range(30)]
    p = R.Params(followers=followers, block=2000, part=400)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    where, got = {}, Counter()
    for part, packed in R.counted_features(docs, 7, p).collect():
        for k in (1, 2, 3):
            features, count = R._unpacked(bytes(packed), k)
            got.update(dict(zip(features.to_pylist(), count.tolist(), strict=True)))
            for f in features.to_pylist():
                where.setdefault(f.split()[0], set()).add(part)
    want = Counter(" ".join(w[i : i + k]).encode() for w in (t.split() for t in texts) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == want
    assert (len(where[b"the"]) > 1) and (followers == 2 or sum(len(v) == 1 for v in where.values()) == 40)
    total = [0] * p.buckets
    for f, n in want.items():
        total[zlib.crc32(f) % p.buckets] += n
    assert R.bucket_counts(docs, p).tolist() == total

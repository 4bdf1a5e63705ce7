import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loamspark.llm import toxicity as X
from loamspark.llm.common import read_table
from loamspark.llm.strings import words_of

SMALL = X.Params(window=6, step=3, hidden=3, word=4, letters=3, gram_bits=6, batch=5, texts=4, steps=3)


def plain_logits(model, text):
    """Of every window of a text, a word and a number at a time."""
    p, w = model.params, model.weight
    words = [x.encode() for x in re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())]
    vocabulary, vectors = model.words.to_pylist(), []
    for x in words:
        gram, _ = X.grams(pa.array([x], pa.large_binary()), p)
        letters = w["letters"][gram].mean(0) if len(gram) else np.zeros(p.letters)
        vectors.append(np.concatenate([w["word"][vocabulary.index(x) if x in vocabulary else -1], letters]))
    out, s = [], X.sigmoid
    for a in range(0, max(1, len(words) - p.window + p.step), p.step):
        own, states = vectors[a : a + p.window], {}
        for d in "fb":
            h, states[d] = np.zeros(p.hidden), []
            for x in own if d == "f" else own[::-1]:
                g, u, k = x @ w[f"in{d}"] + w[f"bias{d}"], h @ w[f"state{d}"], p.hidden
                z, r = s(g[:k] + u[:k]), s(g[k : 2 * k] + u[k : 2 * k])
                h = (1 - z) * np.tanh(g[2 * k :] + r * u[2 * k :]) + z * h
                states[d].append(h)
        if not own:
            out.append(float(w["bias"][0]))
            continue
        both = np.array(states["f"]) @ w["poolf"] + np.array(states["b"][::-1]) @ w["poolb"]
        a_t = np.exp(both[:, 0] - both[:, 0].max())
        out.append(float((a_t * both[:, 1]).sum() / a_t.sum() + w["bias"][0]))
    return out


def texts(seed=2, n=12):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["It's", "a", "b1", "übel", "Moron!", "x" * 30, "\n", "日本"]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def model(p=SMALL):
    own = X.fresh(pa.array([b"a", b"moron", b"s"], pa.large_binary()), p)
    own.weight["bias"][:] = 0.3
    return own


def test_windows_hold_every_word():
    for n in range(40):
        b = X.block_of(["other words", " ".join(f"w{i}" for i in range(n))], SMALL)
        own = [b.ids[b.start[i] : b.start[i] + b.size[i]].tolist() for i in range(b.first[1], b.first[2])]
        assert [x for i, part in enumerate(own) for x in part[3 * (i > 0) :]] == b.ids[2 : 2 + n].tolist() and len(own) == max(1, -(-(n - 3) // 3))


def test_logits_equal_plain_loops():
    own, every = model(), texts()
    found = own.logits(X.block_of(every, SMALL))
    assert np.allclose(found, [x for t in every for x in plain_logits(own, t)], atol=1e-4)
    assert np.allclose(own.of_texts(X.block_of(every, SMALL)), [max(plain_logits(own, t)) for t in every], atol=1e-4)


def test_gradients_equal_differences():
    own, every = model(), texts(3, 4)
    own.weight = {k: v.astype(np.float64) for k, v in own.weight.items()}
    b, y = X.block_of(every, SMALL), np.array([1, 0, 1, 0])
    windows, owner = np.arange(b.first[-1]), np.repeat(np.arange(4), np.diff(b.first))

    def loss():
        total = 0.0
        for i, t in enumerate(every):
            top = np.log(np.exp(plain_logits(own, t)).sum())
            total += np.log1p(np.exp(-top)) if y[i] else np.log1p(np.exp(top))
        return total / 4

    found = own.gradients(b, windows, owner, y)
    for name, w in own.weight.items():
        g = found[name]
        if isinstance(g, tuple):
            g = np.zeros_like(w)
            np.add.at(g, found[name][0], found[name][1])
        for at in [(0, 0), (1, 1), (2, 1)] if w.ndim == 2 else [(0,)]:
            kept, e = w[at], 1e-4
            w[at] = kept + e
            up = loss()
            w[at] = kept - e
            down = loss()
            w[at] = kept
            assert abs(g[at] - (up - down) / (2 * e)) < 2e-3, (name, at)


def test_grams_mark_the_ends():
    words = words_of(["ab abc b abcdef"]).words.dictionary_encode().dictionary
    gram, first = X.grams(words, X.Params())
    assert np.diff(first).tolist() == [2, 4, 1, 10]  # of 3 and 5 bytes, with a mark at either end
    assert gram[0] == X.grams(pa.array([b"abc"], pa.large_binary()), X.Params())[0][0]


def test_learns_planted_words(spark):
    rng = random.Random(8)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        own, y = [rng.choice(clean) for _ in range(rng.randint(5, 90))], int(i % 4 == 0)
        if y:
            own[rng.randrange(len(own))] = rng.choice(["Zounds!", "zoundrel", "knave,"])
        rows.append((i, " ".join(own)))
        labels.append((i, y))
    p = X.Params(steps=120)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = [r for r in X.classify(spark, docs, labels, p).collect() if r["held_out"]]
    right = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in found]
    assert len(found) > 200 and sum(right) > 0.95 * len(right)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found)


def test_odd_rows(spark):
    a, b = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(99, None, "x"), (a, "", "x"), (None, "word", None), (b, "a " * 5000, "x"), (b, "a " * 5000, "x")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in X.classify(spark, docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(a, 1), (b, 1), (None, 0), (99, None)], "doc_id long, toxic int")
    assert {r["score"] for r in X.classify(spark, docs, one).collect()} == {1.0}
    assert X.classify(spark, docs.limit(0), one).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_documents(spark, folder):
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    rows = X.classify(spark, docs, labels, X.Params(steps=60)).collect()
    assert len(rows) == docs.count()
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    order = sorted(held, key=lambda r: -r["score"])[:12]
    assert sum(toxic[r["doc_id"]] for r in order) >= 6  # a sixth of the rows are toxic

"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words (runs of letters and digits, in lower case) enter as the vector of the word, if it is
one of the learned vocabulary, beside the mean vector of its hashed character n-grams, which says
something of words never seen. Overlapping windows of words are read in both directions; attention
over the positions of a window gives its logit. The greatest logit of a text's windows, all of which
are scored, goes through a logistic calibration.

Vectors start with how telling a word or n-gram is: the signed root of the likelihood ratio of its
texts' labels. The network is trained on a bounded sample of labelled rows whose fold is not 1: of each label the
``sample`` rows with the least hash of their doc_id, texts of more than ``longest`` characters left
out. Only labels of documents are known, so the loss sees a text by the soft maximum of its windows.
A fifth of the sample, by hash, takes no part in the fit and calibrates the scores; each label then
weighs as much as it has rows among all labelled ones that may be learned from. Labels, lang, source
and doc_id are never inputs of a score. Scoring shuffles nothing.

Defined results: null, empty and wordless texts have one window of no words. Where the learning rows
don't have both labels, every score is the share of toxic ones among them, 0 without any. Rows with a
null label are not learned from; a doc_id with several labels or texts counts once for each. Repeated
rows score alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, slices
from .kernels import BASE, mix
from .strings import places, words_of


@dataclass(frozen=True)
class Params:
    sample: int = 2_000  #: learning rows of each label at most
    longest: int = 12_000  #: characters of a text that is learned from
    window: int = 24  #: words
    step: int = 12  #: words from one window to the next
    hidden: int = 8  #: units of each direction
    word: int = 12  #: numbers of a word's vector
    letters: int = 8  #: numbers of an n-gram's vector
    vocabulary: int = 20_000  #: words at most, those of the most texts
    grams: tuple[int, ...] = (3, 5)  #: bytes of an n-gram
    gram_bits: int = 15
    steps: int = 400  #: of the training
    texts: int = 32  #: of a step, half of them toxic
    windows: int = 16  #: of a text in a step: half of them the most telling ones, half at random
    unknown: float = 0.2  #: share of the words of a step that are read by their letters alone
    rate: float = 0.02
    decay: float = 1e-4  #: of the weights, a step
    bound: float = 4.0  #: of logits, for the calibration
    threshold: float = 0.7
    block: int = 4_000_000  #: characters of a block of texts, about
    batch: int = 4096  #: windows that are read at once
    seed: int = 12


# --- inputs ------------------------------------------------------------------------------


@dataclass
class Block:
    """Different words of some texts and the windows of the texts."""

    words: pa.Array
    ids: np.ndarray  #: number of each word of the texts, and then of no word
    gram: np.ndarray  #: buckets of the words' n-grams, in order of the words
    gram_first: np.ndarray  #: number of each word's first n-gram, and the number of n-grams
    start: np.ndarray  #: place in ids of each window's first word
    size: np.ndarray  #: words of each window
    first: np.ndarray  #: number of each text's first window, and the number of windows


def grams(words: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of bytes of each word, whose ends are marked, and the number of each word's first one."""
    offsets, data = places(words)
    size, n = np.diff(offsets), len(words)
    start = offsets[:-1] - offsets[0] + 2 * np.arange(n)
    text = np.full(int(size.sum()) + 2 * n, 2, np.uint64)  # a mark before and after each word
    inside = np.ones(len(text), bool)
    inside[start] = inside[start + size + 1] = False
    text[inside] = data[offsets[0] : offsets[-1]]
    counts = [np.maximum(size + 3 - k, 0) for k in p.grams]
    first = np.concatenate(([0], np.cumsum(sum(counts))))
    out, before = np.empty(first[-1], np.int32), np.zeros(n, np.int64)
    for k, count in zip(p.grams, counts, strict=True):
        own = np.repeat(np.arange(n), count)
        at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        h = np.full(len(own), k, np.uint64)
        for i in range(k):
            h = h * BASE + text[start[own] + at + i]
        out[first[own] + before[own] + at] = mix(h) >> np.uint64(64 - p.gram_bits)
        before += count
    return out, first


def block_of(texts: list[str], p: Params) -> Block:
    w = words_of([t.lower() for t in texts])
    found = w.words.dictionary_encode()
    gram, gram_first = grams(found.dictionary, p)
    n = np.diff(w.first)
    windows = np.maximum(1, -(-(n - p.window + p.step) // p.step))
    first = np.concatenate(([0], np.cumsum(windows)))
    at = (np.arange(first[-1]) - np.repeat(first[:-1], windows)) * p.step
    ids = np.concatenate((found.indices.to_numpy(), np.full(p.window, len(found.dictionary)))).astype(np.int32)
    return Block(found.dictionary, ids, gram, gram_first, np.repeat(w.first[:-1], windows) + at, np.clip(np.repeat(n, windows) - at, 0, p.window), first)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# --- the network -------------------------------------------------------------------------


@dataclass
class Model:
    params: Params
    words: pa.Array  #: the vocabulary
    weight: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None  #: the score of every text, if nothing could be learned

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Rows of the word vectors; unknown words have the last."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), len(self.words)).to_numpy().astype(np.int64)

    def inputs(self, b: Block, only: np.ndarray | None = None, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of the words of a block (or some of them), the numbers of the words, and of their n-grams' words."""
        first, gram = b.gram_first, b.gram
        if only is not None:
            size = np.diff(first)[only]
            first = np.concatenate(([0], np.cumsum(size)))
            gram = gram[np.repeat(b.gram_first[only] - first[:-1], size) + np.arange(first[-1])]
        number = self.numbers(b.words if only is None else b.words.take(pa.array(only)))
        if hidden is not None:
            number = np.where(hidden[only], len(self.words), number)
        size = np.maximum(np.diff(first), 1)[:, None].astype(np.float32)
        some = np.flatnonzero(np.diff(first))
        mean = np.zeros((len(number), self.params.letters), np.float32)
        if len(some):
            mean[some] = np.add.reduceat(self.weight["letters"][gram], first[some])
        return np.hstack([self.weight["word"][number], mean / size]), number, gram

    def logits(self, b: Block) -> np.ndarray:
        """Of each window of a block."""
        p, w = self.params, self.weight
        x, _, _ = self.inputs(b)
        put = [np.vstack([x @ w[f"in{d}"] + w[f"bias{d}"], np.zeros((1, 3 * p.hidden), np.float32)]).astype(np.float32) for d in "fb"]
        out = np.empty(len(b.start), np.float32)
        full = b.size == p.window
        for some in (np.flatnonzero(full), np.flatnonzero(~full)):
            for a in range(0, len(some), p.batch):
                own = some[a : a + p.batch]
                size = b.size[own]
                e, c = (np.zeros((p.window, len(own)), np.float32) for _ in range(2))
                for d, order in (("f", range(p.window)), ("b", range(p.window - 1, -1, -1))):
                    h = np.zeros((len(own), p.hidden), np.float32)
                    for t in order:
                        h = self.cell(d, put[d == "b"], b.ids[b.start[own] + t], h)[0]
                        if size[0] < p.window:
                            h *= (t < size)[:, None]
                        both = h @ w[f"pool{d}"]
                        e[t] += both[:, 0]
                        c[t] += both[:, 1]
                e[np.arange(p.window)[:, None] >= np.maximum(size, 1)[None, :]] = -np.inf
                a_t = np.exp(e - e.max(0))
                out[own] = (a_t * c).sum(0) / a_t.sum(0) + w["bias"]
        return out

    def cell(self, d: str, put: np.ndarray, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and the gates z and r, the proposal n and its part q from the state."""
        k, w = self.params.hidden, self.weight
        g, u = put[ids], h @ w[f"state{d}"]
        gates = g[:, : 2 * k] + u[:, : 2 * k]
        np.negative(gates, out=gates)
        np.exp(np.minimum(gates, 30, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, q = gates[:, :k], gates[:, k:], u[:, 2 * k :]
        n = np.tanh(g[:, 2 * k :] + r * q)
        return n + z * (h - n), z, r, n, q

    def of_texts(self, b: Block) -> np.ndarray:
        """The greatest logit of each text."""
        return np.maximum.reduceat(self.logits(b), b.first[:-1]) if len(b.first) > 1 else np.zeros(0)

    def bounded(self, b: Block) -> np.ndarray:
        """The logit of each text, within bounds, so that a few wrong labels don't level the calibration."""
        return np.clip(self.of_texts(b).astype(np.float64), -self.params.bound, self.params.bound)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.slope * self.bounded(block_of(texts, self.params)) + self.shift)

    def gradients(self, b: Block, windows: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean logistic loss of texts, each seen by the soft maximum of its windows; ``owner`` is a window's text.

        The words of a block that ``hidden`` marks are read as unknown ones.
        """
        p, w = self.params, self.weight
        k, size, m = p.hidden, b.size[windows], len(windows)
        at = b.ids[b.start[windows][:, None] + np.arange(p.window)]
        only, own = np.unique(np.where(np.arange(p.window) < size[:, None], at, len(b.words)), return_inverse=True)
        own, none = own.reshape(at.shape), only[-1] == len(b.words)
        x, number, gram = self.inputs(b, only[:-1] if none else only, hidden)
        put = [np.vstack([x @ w[f"in{d}"] + w[f"bias{d}"], np.zeros((1, 3 * k))]).astype(np.float32) for d in "fb"]
        kept, both = {}, np.zeros((p.window, m, 2), np.float32)
        mask = (np.arange(p.window)[:, None] < size[None, :])[:, :, None]
        orders = {"f": range(p.window), "b": range(p.window - 1, -1, -1)}
        for d, order in orders.items():
            h = np.zeros((m, k), np.float32)
            for t in order:
                new, *gates = self.cell(d, put[d == "b"], own[:, t], h)
                kept[d, t] = (h, *gates)
                h = new * mask[t]
                kept[d, t] += (h,)
                both[t] += h @ w[f"pool{d}"]
        e, c = both[:, :, 0], both[:, :, 1]
        e = np.where((np.arange(p.window)[:, None] < np.maximum(size, 1)), e, -np.inf)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a * c).sum(0)
        logit = pooled + w["bias"]
        top = np.full(len(y), -np.inf)
        np.maximum.at(top, owner, logit)
        part = np.exp(logit - top[owner])
        total = np.bincount(owner, part, len(y))
        loss = (sigmoid(top + np.log(total)) - y) / len(y)
        d_logit = (loss[owner] * part / total[owner]).astype(np.float32)
        out = {name: np.zeros_like(v) for name, v in w.items() if name not in ("word", "letters")}
        out["bias"] += d_logit.sum()
        d_both = np.stack([a * (c - pooled) * d_logit, a * d_logit], 2)
        d_x = np.zeros_like(x)
        for d, order in orders.items():
            state, pool, d_put, dh = w[f"state{d}"], w[f"pool{d}"], np.zeros_like(put[0]), np.zeros((m, k), np.float32)
            for t in reversed(order):
                h, z, r, n, q, after = kept[d, t]
                out[f"pool{d}"] += after.T @ d_both[t]
                dh = (dh + d_both[t] @ pool.T) * mask[t]
                d_n = dh * (1 - z) * (1 - n * n)
                gate = np.hstack([dh * (h - n) * z * (1 - z), d_n * q * r * (1 - r)])
                from_state = np.hstack([gate, d_n * r])
                np.add.at(d_put, own[:, t], np.hstack([gate, d_n]))
                out[f"state{d}"] += h.T @ from_state
                dh = dh * z + from_state @ state.T
            d_put = d_put[: len(x)]
            out[f"in{d}"] += x.T @ d_put
            out[f"bias{d}"] += d_put.sum(0)
            d_x += d_put @ w[f"in{d}"].T
        count = np.diff(b.gram_first)[only[:-1] if none else only]
        each = d_x[:, p.word :] / np.maximum(count, 1)[:, None]
        out["word"] = (number, d_x[:, : p.word])
        out["letters"] = (gram, np.repeat(each, count, axis=0))
        return out


def fresh(words: pa.Array, p: Params) -> Model:
    rng, k, size = np.random.default_rng(p.seed), p.hidden, p.word + p.letters
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    weight = {"word": draw(len(words) + 1, p.word, scale=0.3), "letters": draw(1 << p.gram_bits, p.letters, scale=0.6), "bias": np.full(1, -2, np.float32)}
    weight["word"][-1] = 0
    for d in "fb":
        weight |= {f"in{d}": draw(size, 3 * k, scale=size**-0.5), f"bias{d}": np.zeros(3 * k, np.float32), f"state{d}": draw(k, 3 * k, scale=k**-0.5), f"pool{d}": draw(k, 2, scale=0.5)}
    return Model(p, words, weight)


def told(text: np.ndarray, item: np.ndarray, size: int, y: np.ndarray) -> np.ndarray:
    """How telling each item is, from pairs of a text and an item: a third of the signed root of its likelihood ratio."""
    share = y.mean()
    n, toxic = np.bincount(item, minlength=size)[:size], np.bincount(item, y[text], size)[:size]
    ratio = sum(o * np.log(np.maximum(o, 1e-9) / np.maximum(n * q, 1e-9)) for o, q in ((toxic, share), (n - toxic, 1 - share)))
    return (np.sign(toxic - n * share) * np.sqrt(np.maximum(2 * ratio, 0)) / 3).astype(np.float32)


def train(texts: list[str], y: np.ndarray, p: Params) -> Model:
    """A network fitted to texts and their labels, both of which occur, by steps of Adam."""
    b = block_of(texts, p)
    rng, own = np.random.default_rng(p.seed), np.diff(np.append(b.start[b.first[:-1]], len(b.ids) - p.window))
    pair = np.unique(np.repeat(np.arange(len(texts)), own) * (len(b.words) + 1) + b.ids[: own.sum()])
    text, word = pair // (len(b.words) + 1), pair % (len(b.words) + 1)
    often, telling = np.bincount(word, minlength=len(b.words)), told(text, word, len(b.words), y)
    top = np.lexsort((np.arange(len(often)), -often))[: p.vocabulary]
    top = top[often[top] > 1]  # words of two texts or more, the most frequent ones
    model = fresh(b.words.take(pa.array(top)), p)
    model.weight["word"][:-1, 0] = telling[top]
    count = np.diff(b.gram_first)[word]
    gram = b.gram[np.repeat(b.gram_first[word] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    pair = np.unique(np.repeat(text, count) << p.gram_bits | gram)
    model.weight["letters"][:, 0] = told(pair >> p.gram_bits, pair & ((1 << p.gram_bits) - 1), 1 << p.gram_bits, y)
    most = np.append(telling, -9)[b.ids[b.start[:, None] + np.arange(p.window)]].max(1)
    ordered = [b.first[i] + np.argsort(-most[b.first[i] : b.first[i + 1]], kind="stable") for i in range(len(texts))]
    sides = [np.flatnonzero(y == v) for v in (0, 1)]
    moments = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in model.weight.items()}
    for step in range(1, p.steps + 1):
        rate = p.rate * min(1, 2 * (1 - (step - 1) / p.steps)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        own = np.concatenate([rng.choice(s, p.texts // 2, replace=len(s) < p.texts // 2) for s in sides])
        half = p.windows // 2
        parts = [np.concatenate((ordered[i][:half], rng.choice(ordered[i][half:], min(half, len(ordered[i]) - half), replace=False))) if len(ordered[i]) > half else ordered[i] for i in own]
        windows, owner = np.concatenate(parts), np.repeat(np.arange(len(own)), [len(x) for x in parts])
        hidden = rng.random(len(b.words)) < p.unknown
        for name, g in model.gradients(b, windows, owner, y[own], hidden).items():
            w, (m, v) = model.weight[name], moments[name]
            rows: slice | np.ndarray = slice(None)
            if isinstance(g, tuple):  # the rows of a table that occur
                rows, back = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(rows), w.shape[1]), np.float32)
                np.add.at(total, back, g[1])
                g = total
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.999 * v[rows] + 0.001 * g * g
            w[rows] -= (rate * m[rows] / (np.sqrt(v[rows]) + 1e-8) + p.decay * w[rows]).astype(np.float32)
    return model


def calibrate(model: Model, texts: list[str], y: np.ndarray, weight: np.ndarray) -> None:
    """Fit slope and shift of the logistic curve by Newton's method, with labels drawn in from 0 and 1 by one row each."""
    x = model.bounded(block_of(texts, model.params))
    n = np.array([(y == v).sum() for v in (0, 1)])
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    both, beta = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
    for _ in range(50):
        s = sigmoid(both @ beta)
        hessian = (both * (weight * np.maximum(s * (1 - s), 1e-6))[:, None]).T @ both + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, both.T @ (weight * (s - target)) + 1e-3 * (beta - [1, 0]))
        beta -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    model.slope, model.shift = max(float(beta[0]), 0.05), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Learn from a bounded sample of the rows that have a label (doc_id, toxic) and are not held out."""
    own = labels.where("toxic in (0, 1) and doc_id is not null").where(fold() != 1).select("doc_id", F.col("toxic").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # Ids alone give no text; twice as many are taken, as some have none or a long one.
    order = F.xxhash64("doc_id", F.lit(p.seed))
    taken = [own.where(F.col("y") == v).orderBy(order, "doc_id").limit(2 * p.sample) for v in (0, 1)]
    texts = docs.select("doc_id", "text").where(F.length("text") <= p.longest).join(F.broadcast(taken[0].union(taken[1])), "doc_id")
    rows = sorted({(r["h"], r["doc_id"], r["text"], r["y"]) for r in texts.select(order.alias("h"), "doc_id", "text", "y").collect()})
    rows = [r for v in (0, 1) for r in [x for x in rows if x[3] == v][: p.sample]]
    y = np.array([r[3] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return Model(p, pa.array([], pa.large_binary()), constant=counts.get(1, 0) / max(sum(counts.values()), 1))
    apart = np.zeros(len(rows), bool)
    for v in (0, 1):  # every fifth of each label in order of the hash
        apart[np.flatnonzero(y == v)[::5]] = True
    if any((y[~apart] == v).sum() == 0 for v in (0, 1)):
        apart[:] = False
    pick = lambda mask: [r[2] for r, m in zip(rows, mask, strict=True) if m]
    model = train(pick(~apart), y[~apart], p)
    late = apart if apart.any() else ~apart
    weight = np.array([counts[v] / max((y[late] == v).sum(), 1) for v in (0, 1)])
    calibrate(model, pick(late), y[late], (weight / weight.sum() * late.sum())[y[late]])
    return model


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = spark.sparkContext.broadcast(fit(docs, labels, p))  # of the size of the vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for ids, texts in slices(x, p.block):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shared.value(texts))], schema=schema)

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))

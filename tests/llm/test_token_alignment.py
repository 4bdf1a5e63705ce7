import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from loamspark.llm import token_alignment as A
from loamspark.llm.common import read_table

P = A.Params(block=700, chunk=90)  # many blocks and calls
ODD = [None, "", " ", "a", "a  b", " a ", "a \n b", "tail ", "x y ", "a  b", "▁ in a text", "it's <s> </s> <|endoftext|> here", "\x00 \x1c .", "ﬁ Å 日本　語 🙂", "a" * 500, "one two " * 60, "\t\t  \n"]


def plain(texts):
    """Whole texts by the public libraries, their ends met by plain sets."""
    one = Tokenizer.from_file(P.a)
    one.encode_special_tokens = True
    two, letter = sentencepiece.SentencePieceProcessor(model_file=P.b), A.byte_letters()
    rows, count = [], Counter()
    for t in texts:
        a = one.encode(" " + (t or ""), add_special_tokens=False).ids
        b = two.encode(t or "")
        bytes_a = [bytes(letter[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(bytes_a) != (want := (" " + t).encode()) or b"".join(bytes_b) != want:
            rows.append(([], [], []))
            continue
        ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (bytes_a, bytes_b)]
        cuts = sorted({*ends[0]} & {*ends[1]})
        begin, groups = 0, []
        for c in cuts:
            groups.append(([i for i, e in zip(a, ends[0]) if begin < e <= c], [i for i, e in zip(b, ends[1]) if begin < e <= c]))
            begin = c
        links = [(i, j) for i, e in zip(a, ends[0]) for j, f in zip(b, ends[1]) if e == f] if len(a) < 300 else [(x[-1], y[-1]) for x, y in groups]
        count.update(links)
        rows.append((groups, links, [*zip([0, *cuts], cuts)]))
    return rows, count


def expected(texts):
    rows, count = plain(texts)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for groups, links, _ in rows:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


def test_equals_whole_texts_by_the_public_libraries(spark):
    rng, alphabet = random.Random(3), [*"ab  e\n\t .,!é1", "　", " ", "\x1c", "▁", "'s", "the ", "ing ", " hello"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(None if i == 5 else i // 2 if i > 250 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string")
    docs = docs.coalesce(1)
    found = A.align(spark, docs, P).collect()
    assert [r["doc_id"] for r in found] == [r["doc_id"] for r in docs.collect()]
    assert [tuple(r)[1:] for r in found] == expected(texts)


def test_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").limit(120)
    rows = docs.collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in A.align(spark, docs).collect()}
    want = expected([r["text"] for r in rows])
    assert [found[r["doc_id"]] for r in rows] == want


def test_groups(spark):
    texts = ["it's a tokenizer, über alles", None, "a  b ▁", "plain words  here "]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows, _ = plain(texts)
    want = [(i, a, z, *g) for i, (groups, _, spans) in enumerate(rows) for (a, z), g in zip(spans, groups)]
    assert [(r["doc_id"], r["start"], r["end"], r["a"], r["b"]) for r in A.groups(docs, P).orderBy("doc_id", "start").collect()] == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "▁")]])
def test_nothing_to_align(spark, rows):
    found = A.align(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r)[1:] for r in found] == [(0, 0, 0, 0, 0, 0, "")] * len(rows)


def test_rank():
    import numpy as np

    at = np.array([0, 5, 63, 64, 130])
    bits = A.packed(at, 131)
    assert A.rank(bits, np.arange(131)).tolist() == [int((at <= i).sum()) for i in range(131)]

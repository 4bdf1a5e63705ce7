import itertools
from collections import Counter
from fractions import Fraction

from loamspark.llm import mixing as M


def whole(supply, p):
    return [x for own in M.phases(supply, p) for k in range(own.frames) for x in M.frame(own, k)]


def test_a_frame_by_itself_stays_within_one_turn():
    for parts in ({"a": 5, "b": 3, "c": 2}, {"a": 97, "b": 2, "c": 1}, {s: 1 for s in "abcdefg"}):
        slots, seen = sum(parts.values()), Counter()
        for at, s in enumerate(itertools.islice(M.turns(parts), slots), 1):
            seen[s] += 1
            assert all(abs(seen[s] - at * q / slots) < 1 for s, q in parts.items())
        assert seen == Counter(parts)


def test_given_weights_hold_in_every_frame():
    """Two half blocks are one block: never that far from the weights as given, over 100,000 slots."""
    hot = {"hot": 0.5} | {f"s{k}": 0.0025 for k in range(200)}
    cases = [({"a": 1, "b": 2}, 200_000, 100_000, 64), ({"a": 0.9, "b": 0.1}, 200_000, 100_000, 1000), (hot, 20_000, 9000, 500), ({}, None, 3000, 300)]
    for weights, each, n, size in cases:
        own = dict.fromkeys(weights, each) if weights else {"big": 20_000} | {f"s{k}": 200 for k in range(170)}
        target = weights or {s: x**0.5 for s, x in own.items()}
        total, seen, now = sum(map(Fraction, target.values())), Counter(), 0
        share = {s: float(Fraction(w) / total) for s, w in target.items()}
        found = M.phases(own, M.Params(weights=weights, frame=size))
        for s, j, slot in itertools.islice((x for own in found for k in range(own.frames) for x in M.frame(own, k)), n):
            assert (j, slot) == (seen[s], now)
            seen[s], now = seen[s] + 1, now + 1
            if now % 7 == 0:
                assert all(abs(seen[s] - now * w) < 2 for s, w in share.items())
        assert now == n and found[0].frames > 1


def test_every_half_block_has_one_turn():
    for supply, p in (({"a": 1, "b": 1}, M.Params(weights={"a": 0.7})), ({"a": 9, "b": 500, "c": 1, "d": 77}, M.Params(frame=10)), ({"a": 50, "b": 3}, M.Params(weights={"a": 1e-9, "b": 1})), ({}, M.Params())):
        got = whole(supply, p)
        assert sorted((s, j) for s, j, _ in got) == sorted((s, j) for s, n in supply.items() for j in range(n))
        assert [slot for *_, slot in got] == list(range(len(got)))


def test_every_document_has_one_place(spark):
    rows = [(i, "a" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    p = M.Params(block=4, frame=20, bucket=64, weights={"a": 0.5} | {f"s{k}": 0.5 / 7 for k in range(7)})
    got = M.schedule(spark, docs, p).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000)) and {(r["doc_id"], r["source"]) for r in got} == set(rows)
    assert len({(r["slot"], r["place"]) for r in got}) == 3000
    order, blocks = {}, {}
    for r in got:
        order[r["slot"]] = r["source"]
        blocks.setdefault((r["source"], r["block"]), set()).add(r["slot"])
    assert all(len(x) <= 2 for x in blocks.values()) and sorted(order) == list(range(len(order)))
    want = {slot: s for s, _, slot in whole({s: -(-n // 2) for s, n in Counter(s for _, s in rows).items()}, p)}
    assert order == want


def test_mixed_keeps_rows_and_columns(spark):
    rows = [(1, "t", "a", 0, 5), (1, "t", "a", 0, 5), (2, None, None, 0, 6), (None, "", "b", 0, 7), (None, "", "b", 0, 7), (3, "x" * 100_000, "b", 0, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bucket long, _key long")
    got = M.mixed(spark, docs)
    assert got.columns == [*docs.columns, "slot", "place"]
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(rows)
    clash = M.mixed(spark, docs.selectExpr("7 AS slot", "*", "8 AS place", "9 AS uid"))
    assert clash.columns == ["doc_id", "text", "source", "bucket", "_key", "uid", "slot", "place"]
    assert len({(r["slot"], r["place"]) for r in clash.collect()}) == len(rows) and {r["uid"] for r in clash.collect()} == {9}
    assert M.mixed(spark, docs.limit(0)).count() == 0 and M.schedule(spark, docs.limit(0)).count() == 0

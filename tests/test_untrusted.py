import json
import random

import pytest

from loamspark.operators import untrusted as O


def plain(value, depth=0):
    """(value, code) by a recursion of its own."""
    if depth > 3:
        return None, "too_deep"
    if isinstance(value, (list, dict)):
        if isinstance(value, list) and len(value) > 20:
            return None, "array_too_large"
        out = []
        for k, v in enumerate(value) if isinstance(value, list) else value.items():
            if isinstance(value, dict) and any(x in k.lower() for x in ("content", "prompt", "token", "secret", "password", "stack", "row", "payload", "knowledge")):
                return None, "unsafe_key"
            new, code = plain(v, depth + 1)
            if code:
                return None, code
            out.append((k, new))
        return ([v for _, v in out] if isinstance(value, list) else dict(out)), None
    return value[:256] if isinstance(value, str) else value, None


def document(rng, depth=0):
    kind = rng.random()
    if depth == 0 or kind < 0.25 and depth < 5:
        keys = ["a", "name", "id", "é", *(["apiToken", "ROW", "knowledgeBase"] if rng.random() < 0.1 else [])]
        return {rng.choice(keys): document(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if kind < 0.4 and depth < 5:
        return [document(rng, depth + 1) for _ in range(rng.choice([0, 2, 20, 21]) if rng.random() < 0.2 else 2)]
    return rng.choice([None, True, 1, 2.5, "text", "x" * 300, "é" * 257])


@pytest.mark.parametrize("seed", range(5))
def test_equals_a_plain_recursion(seed):
    rng = random.Random(seed)
    for _ in range(300):
        x = document(rng)
        value, code = plain(x)
        text = None if code else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        if text and len(text.encode()) > 4096:
            text, code = None, "too_large"
        assert O.sanitised(json.dumps(x)) == (text, code and O.REFUSED + code)


@pytest.mark.parametrize(("text", "code"), [("[" * 100_000, "too_deep"), ('{"a": NaN}', "invalid_value"), ("1", "invalid_value"), ("", "invalid_value"), ("{", "invalid_value")])
def test_hostile(text, code):
    assert O.sanitised(text) == (None, O.REFUSED + code)


def test_log_is_only_added_to(spark):
    kind = "id long, metadata string"
    log = spark.createDataFrame([(1, "{}")], kind)
    after, refused = O.append_events(log, spark.createDataFrame([(1, '{"x":1}'), (2, None), (2, None), (3, '{"token":1}')], kind))
    assert sorted(map(tuple, after.collect())) == [(1, "{}"), (2, "{}")] and [tuple(r) for r in refused.collect()] == [(3, O.REFUSED + "unsafe_key")]


def test_cyclic_indexes_end(spark):
    index = lambda *urls: "<sitemapindex>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</sitemapindex>"
    a = "https://a.example/"
    documents = [(a + "1", index(a + "2", a + "1")), (a + "2", index(a + "3", a + "1")), (a + "3", f"<urlset><loc>{a}x</loc><loc>https://b.example/y</loc></urlset>")]
    pages, read = O.followed_sitemaps(spark.createDataFrame(documents, "url string, body string"), spark.createDataFrame([(7, a + "1"), (8, a + "3"), (9, a + "none")], "site long, url string"))
    assert sorted(map(tuple, pages.collect())) == [(7, a + "x"), (8, a + "x")]
    assert sorted(map(tuple, read.collect())) == [(7, a + "1", 0), (7, a + "2", 1), (7, a + "3", 2), (8, a + "3", 0)]

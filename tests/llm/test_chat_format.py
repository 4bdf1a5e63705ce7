import json

from loamspark.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, level int, part string"


def call(*calls):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), (c[0], c[1], json.dumps(c[2]) if not isinstance(c[2], str) else c[2], c[3]), strict=True)) for c in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows):
    return C.format_chats(spark, spark.createDataFrame([(*r, 0, "p") for r in rows], SCHEMA)).collect()


def test_links_order_validation_and_canonical_json(spark):
    rows = [
        (1, 0, "user", "é \"hi\"\n"),
        (1, 1, "assistant", call(("b", "fetch", {"url": "u"}, ["a"]), ("a", "search", {"query": "q", "limit": 2}, []), ("c", "search", {"limit": "2"}, ["b"]), ("x", "none", {}, ["y"]), ("y", "search", "no json", ["x"]))),
        (1, 2, "tool", result("a", '{"z":1, "a":[2]}')), (1, 3, "tool", result("b", "plain")), (1, 4, "tool", result("q", "orphan")), (1, 0, "tool", result("c", "too early")),
        (2, 0, "tool", result("a", "of another conversation")),
    ]
    got = {(r["conv_id"], r["turn"], r["role"]): r for r in run(spark, rows)}
    assert got[1, 0, "user"]["record"] == '{"content":"é \\"hi\\"\\n","role":"user","turn":0}' and got[1, 0, "user"]["status"] == "plain"
    own = got[1, 1, "assistant"]
    assert (own["n_calls"], own["n_linked"], own["n_invalid"]) == (5, 2, 3)
    calls = json.loads(own["record"])["tool_calls"]
    assert [(c["id"], c["level"], c["status"], c["valid"]) for c in calls] == [("a", 0, "linked", True), ("b", 1, "linked", True), ("c", 2, "open", False), ("x", None, "open", False), ("y", None, "open", False)]
    assert calls[0]["result"] == {"a": [2], "z": 1} and calls[1]["result"] == "plain"
    assert own["record"] == C.canonical(json.loads(own["record"]))
    assert [got[k]["status"] for k in ((1, 2, "tool"), (1, 4, "tool"), (1, 0, "tool"), (2, 0, "tool"))] == ["result", "orphan", "orphan", "orphan"]


def test_nulls_repeats_long_and_empty(spark):
    long = "x" * 300_000
    rows = [(1, 0, None, None), (1, 0, None, None), (None, None, "user", "a"), (1, 1, "assistant", '{"tool_calls": null}'), (1, 2, "assistant", "{broken tool_calls"), (1, 3, "user", long)]
    got = run(spark, rows)
    assert len(got) == 5 and all(r["status"] == "plain" for r in got)
    assert {r["record"] for r in got} >= {'{"content":"","role":"unknown","turn":0}', '{"content":"a","role":"user","turn":null}', C.canonical({"content": long, "role": "user", "turn": 3})}
    assert run(spark, []) == []


def test_a_call_takes_the_first_later_result(spark):
    rows = [(1, 1, "assistant", call(("a", "search", {"query": "q"}, None))), (1, 3, "tool", result("a", "second")), (1, 2, "tool", result("a", "first")), (1, 4, "assistant", call(("a", "search", {"query": "q"}, None)))]
    got = {r["turn"]: r for r in run(spark, rows)}
    assert json.loads(got[1]["record"])["tool_calls"][0]["result"] == "first" and got[3]["status"] == "orphan"
    assert json.loads(got[4]["record"])["tool_calls"][0]["status"] == "duplicate"


def plain(rows):
    """The records by plain loops."""
    seen = sorted({(c, t, r if r is not None else "unknown", x or "") for c, t, r, x in rows}, key=str)
    turn = lambda m: -(1 << 63) if m[1] is None else m[1]
    made = lambda m: json.loads(m[3])["tool_calls"] if m[2] == "assistant" and m[3].startswith("{") else None
    answer = lambda m: json.loads(m[3]) if m[2] == "tool" and m[3].startswith("{") else None
    calls = [(m, i, c) for m in seen for i, c in enumerate(made(m) or [])]
    first, took, used = {}, {}, set()
    for m, i, c in sorted(calls, key=lambda x: (turn(x[0]), x[1])):
        if c["id"] is not None:
            first.setdefault((m[0], c["id"]), (m, i))
    for (conv, ident), (m, i) in first.items():
        fit = [r for r in seen if answer(r) and r[0] == conv and answer(r)["tool_call_id"] == ident and turn(r) >= turn(m)]
        if fit:
            took[m, i] = min(fit, key=turn)
            used.add(took[m, i])
    level, waits = {}, {(m[0], c["id"]): {(m[0], a) for a in c["after"] or () if (m[0], a) in first} for m, i, c in calls if first.get((m[0], c["id"])) == (m, i)}
    while ready := [k for k in waits if k not in level and all(a in level for a in waits[k])]:
        level |= {k: 1 + max((level[a] for a in waits[k]), default=-1) for k in ready}
    out = []
    for m in seen:
        line = {"role": m[2], "turn": m[1]}
        if made(m) is not None:
            own = sorted(((level.get((m[0], c["id"]), 1 << 30), i, c) for i, c in enumerate(made(m))), key=lambda x: x[:2])
            line["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": C._loads(c["arguments"]), "level": None if n == 1 << 30 else n, "valid": C.fits(C._loads(c["arguments"]), C.SCHEMAS.get(c["name"])), "result": C._loads(answer(took[m, i])["content"]) if (m, i) in took else None, "status": "duplicate" if c["id"] is not None and first[m[0], c["id"]] != (m, i) else "linked" if (m, i) in took else "open"} for n, i, c in own]
        elif answer(m):
            line |= {"tool_call_id": answer(m)["tool_call_id"], "content": C._loads(answer(m)["content"])}
        else:
            line["content"] = m[3]
        out.append((m[0], "calls" if made(m) is not None else ("result" if m in used else "orphan") if answer(m) else "plain", C.canonical(line)))
    return out


def test_equals_plain_loops(spark):
    import random

    rng, rows = random.Random(2), []
    for conv in (1, 2, 3, None):
        for turn in (None, *range(40)):
            if rng.random() < 0.4:
                own = [(rng.choice("abcdefghij") if rng.random() < 0.9 else None, rng.choice(["search", "fetch", "none"]), rng.choice([{"query": "q"}, {"url": "u", "x": 1}, "no json", {"query": True}]), rng.choice([None, [], [rng.choice("abcdefghij")], ["a", "b"]])) for _ in range(rng.randrange(1, 4))]
                rows.append((conv, turn, "assistant", call(*own)))
            elif rng.random() < 0.7:
                rows.append((conv, turn, "tool", result(rng.choice("abcdefghijkl"), rng.choice(["1", "text", '{"b":1,"a":[NaN]}', '{"b":1,"a":[2]}']))))
            else:
                rows.append((conv, turn, rng.choice(["user", None]), rng.choice(["hi", None])))
    got = run(spark, rows + rows[:20])
    assert sorted(((r["conv_id"], r["status"], r["record"]) for r in got), key=str) == sorted(plain(rows), key=str)
    assert sum(r["n_linked"] for r in got) > 5 and any(c["level"] for r in got if r["n_calls"] for c in json.loads(r["record"])["tool_calls"])


def test_what_cannot_be_written_as_json_stays_text(spark):
    odd = ["[" * 200_000, "NaN", '{"a":1e999}', '"\\ud800"', "9" * 5000, "[" * 500 + "]" * 500]
    rows = [(1, i, "tool", result(str(i), x)) for i, x in enumerate(odd)] + [(1, 99, "assistant", call(*((str(i), "search", x, []) for i, x in enumerate(odd))))]
    got = {r["turn"]: r for r in run(spark, rows)}
    assert len(got) == len(rows) and got[99]["n_invalid"] == len(odd)
    for i, x in enumerate(odd[:5]):
        assert json.loads(got[i]["record"])["content"] == x

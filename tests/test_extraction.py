import json

from loamspark.operators import extraction as O

BLOCKS = [(1, "b1", "We offer repairs of all bikes, within two days."), (1, "b2", "Prices start at $20."), (2, "b1", "Other project")]
FACT = {"category": "service", "content": "Repairs of all bikes", "sourceBlockId": "b1", "sourceExcerpt": "repairs of  ALL bikes", "confidence_score": 0.9}


def run(spark, *outputs):
    rows = [(1, i, x if isinstance(x, (str, type(None))) else json.dumps(x)) for i, x in enumerate(outputs)]
    items, issues, verdict = O.validate(spark.createDataFrame(rows, "project long, extraction long, output string"), spark.createDataFrame(BLOCKS, "project long, id string, content string"))
    found = [([], [], None) for _ in outputs]
    for r in items.orderBy("kind", "nth").collect():
        found[r["extraction"]][0].append((r["kind"], r["nth"], r["confidence"]))
    for r in issues.collect():
        found[r["extraction"]][1].append((r["code"], r["path"]))
    valid = {r["extraction"]: r["valid"] for r in verdict.collect()}
    return [(a, sorted(b), valid[i]) for i, (a, b, _) in enumerate(found)]


def test_each_code(spark):
    of = lambda **more: {"facts": [FACT | more]}
    found = run(
        spark, None, "[1]", "{}", "{broken", of(category="none"), of(content="abc"), of(sourceBlockId="b9"), of(sourceExcerpt=" "), of(sourceExcerpt="we sell cars and boats here"), {"facts": ["x"]},
        {"faqCandidates": [{"question": "Q?"}, {"question": "Q?", "answer": "A", "source_block_ids": ["b9"], "source_excerpts": ["x"]}]},
        {"conflicts": [{"topic": "t", "firstStatement": "a", "second_statement": "b", "sourceBlockIds": ["b1"], "sourceExcerpts": ["x", "X"], "suggestedQuestion": "q"}]}, {"missing_information": [{"topic": "t", "reason": "r"}]},
        {"facts": [FACT, FACT | {"content": "repairs of all 'bikes'", "confidence": "low"}]}, {"facts": "no list"},
    )
    root = ([], [("invalid_root", "$")], False)
    assert found[:4] == [root] * 4
    codes = [("invalid_category", "facts[0].category"), ("invalid_fact", "facts[0].content"), ("missing_source_block", "facts[0].sourceBlockId"), ("missing_source_excerpt", "facts[0].sourceExcerpt"), ("source_excerpt_not_found", "facts[0].sourceExcerpt"), ("invalid_category", "facts[0].category")]
    assert found[4:10] == [([], [x], False) for x in codes]
    assert found[10] == ([], [("invalid_faq_candidate", "faqCandidates[0]"), ("missing_source_excerpt", "faqCandidates[1]")], False)
    assert found[11:13] == [([], [("invalid_conflict", "conflicts[0]")], True), ([], [("invalid_missing_item", "missingInformation[0]")], True)]
    assert found[13] == ([("fact", 0, "high")], [("duplicate_item", "facts")], True)
    assert found[14] == ([], [], True)


def test_whole_outputs_in_both_forms(spark):
    output = {
        "facts": [FACT, FACT | {"category": "pricing", "content": "From $20", "source_block_id": "b2", "sourceBlockId": None, "sourceExcerpt": "prices start $20 start prices extra", "confidence_score": "0.6"}],
        "faq_candidates": [{"question": "Fast?", "answer": "Two days", "sourceBlockIds": ["b9", "b1"], "sourceExcerpts": ["within two days"], "confidence": "medium"}, {"question": "fast", "answer": "No", "sourceBlockIds": ["b1"], "sourceExcerpts": ["x"]}],
        "conflicts": [{"topic": "t", "first_statement": "a", "secondStatement": "b", "source_block_ids": ["b1", "b2"], "sourceExcerpts": ["x", "y"], "suggested_question": "q"}],
        "missingInformation": [{"topic": "t", "reason": "r", "suggestedQuestion": "q"}],
    }
    assert run(spark, output) == [([("conflict", 0, None), ("fact", 0, "high"), ("fact", 1, "medium"), ("faq", 0, "medium"), ("missing", 0, None)], [], True)]

"""Held-out accuracy of the trained operators, and their edge cases."""

import numpy as np
import pytest

from loamspark.llm import language_id, quality_classifier, queries
from loamspark.llm.common import read_table

DATA = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "12 !?"), (4, "hello there friend"), (4, "hello there friend"), (None, "hello"), (5, "word " * 100_000)]


def edges(spark):
    return spark.createDataFrame([(i, t, None, True, 0.5) for i, t in EDGES], "doc_id long, text string, lang string, held_out boolean, score double")


def test_language_of_held_out_documents(spark):
    got = queries.op7_language_id(spark, DATA).join(read_table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert not any(r["rejected"] for r in got)


def test_foreign_text_is_rejected(spark):
    docs = read_table(spark, DATA, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    names, scores, rejected = language_id.score_texts(["это русский текст о погоде и городе", "qxz jvwk zzqx kkvj wqpx", None, "123"], model)
    assert rejected == [True] * 4 and names[2:] == ["und", "und"] and scores[2:] == [0.0, 0.0]


def test_language_edge_cases(spark):
    docs = read_table(spark, DATA, "documents").select("doc_id", "text", "lang")
    got = language_id.predict(spark, edges(spark), language_id.fit(docs)).collect()
    assert len(got) == len(EDGES) and [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language_id.identify(spark, edges(spark)).collect()} == {"und"}  # nothing to learn from
    assert language_id.identify(spark, edges(spark).limit(0)).count() == 0
    assert language_id.keep_known(spark, edges(spark)).columns == edges(spark).columns


def test_quality_of_held_out_documents(spark):
    got = queries.op6_quality_classifier(spark, DATA).join(read_table(spark, DATA, "labels"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert good and bad and np.mean([(g > np.array(bad)).mean() + 0.5 * (g == np.array(bad)).mean() for g in good]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        got = quality_classifier.classify(spark, edges(spark), own).collect()
        assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got} == {0.5}
    assert quality_classifier.classify(spark, edges(spark).limit(0), labels).count() == 0


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(2)
    y, w = rng.random(40), rng.integers(1, 5, 40).astype(float)
    got = quality_classifier.isotonic(np.arange(40), y, w)
    # The greatest lower and least upper means of all stretches around a place, which define the fit.
    mean = lambda a, b: np.average(y[a:b], weights=w[a:b])
    want = [max(min(mean(a, b) for b in range(i + 1, 41)) for a in range(i + 1)) for i in range(40)]
    assert got == pytest.approx(want)


def test_unlearned_languages_of_latin_script_are_rejected(spark):
    docs = read_table(spark, DATA, "documents").select("text", "lang")
    foreign = [
        "Tänään on kaunis päivä ja menemme yhdessä metsään kävelemään, koska aurinko paistaa ja linnut laulavat puissa.",
        "Dzisiaj jest piękny dzień i idziemy razem do lasu na spacer, ponieważ świeci słońce, a ptaki śpiewają na drzewach.",
    ]
    assert language_id.score_texts(foreign, language_id.fit(docs))[2] == [True, True]

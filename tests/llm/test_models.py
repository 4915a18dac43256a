"""Language and quality models: held-out accuracy and odd rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from variegate.llm import language, quality
from variegate.llm.vocabulary import read_vocabulary
from variegate.llm.queries import VOCABULARY, op1_bradley_terry, op4_language


def test_language_held_out(spark):
    found = op4_language(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id")
    held = found[found.held_out]
    assert 200 < len(held) < 300 and len(found) == len(docs)
    assert (held.lang_pred == docs.lang[held.index]).mean() > 0.97
    assert found.score.between(0, 1).all()


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for lang, texts in {
        "en": ["the house and the garden", "this is what they think of that"],
        "de": ["das haus und der garten", "das ist was sie dazu denken"]}.items()
        for i, t in enumerate(texts * 20)] + [(90, None, "en"), (91, "nothing", None)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"),
                        read_vocabulary(VOCABULARY))


def test_language_odd_rows(spark, model):
    assert model.languages == ["de", "en"]
    np.testing.assert_allclose(model.chances.sum(0), 1)
    texts = [None, "", "123 !?", "the garden", "der Garten", "THE HOUSE", "漢字", "x" * 5000,
             "the " * 250_000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang_score int")
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert [found[i].lang_pred for i in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert found[6].lang_pred in ("de", "en") and found[8].lang_pred == "en"
    assert all(0 <= r.lang_score <= 1 for r in found.values()) and found[0].lang_score == 0


def test_language_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty, read_vocabulary(VOCABULARY))
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert [r.lang_pred for r in language.predict(docs, model).collect()] == ["und"]
    assert language.predict(docs.limit(0), model).count() == 0


def test_quality_held_out(spark):
    found = op1_bradley_terry(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id").quality
    held = found.loc[[i for i in labels.index if found.held_out[i]]]
    assert len(found) == 1000 and found.score.between(0, 1).all()
    assert (held.predicted == labels[held.index]).mean() > 0.95
    assert ((found.score >= 0.3).astype(int) == found.predicted).all()


def test_bradley_terry_orders_preferences():
    rng = np.random.default_rng(0)
    values = rng.normal(size=(400, len(quality.FEATURES)))
    good = values[:, 3] + 0.3 * rng.normal(size=400) > -0.8
    model = quality.bradley_terry(values, good)
    raw = quality.expanded((values - model.mean) / model.scale) @ model.weights
    model.cut = float(np.quantile(raw, (~good).mean()))
    scores = quality.score(model, values)
    assert (scores[good][:, None] > scores[~good][None, :]).mean() > 0.95
    assert ((scores >= quality.CUT) == good).mean() > 0.9


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, f"Some plain words, number {i}. And more of them.", 1) for i in range(40)]
        + [(100 + i, "### !!! $$$ BUY NOW!!!", 1) for i in range(40)]
        + [(200, None, 1), (201, "", 1), (202, "x" * 200_000, 1), (None, "y", 1), (0, "again", 1)],
        "doc_id long, text string, quality_score int")
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)]
        + [(3, None, 0), (None, 1, 0), (5, 1, 0), (100, 0, 0)], "doc_id long, quality int, text int")
    model = quality.fit(docs, labels, F.col("doc_id") >= 0)
    found = quality.score_quality(docs, model).collect()
    assert len(found) == 85 and all(0 <= r.quality_score <= 1 for r in found)
    by_id = {r.doc_id: r.quality_score for r in found}
    assert min(by_id[i] for i in range(1, 40)) > max(by_id[100 + i] for i in range(40))
    empty = quality.fit(docs, labels.limit(0), F.col("doc_id") >= 0)
    assert {r.quality_score for r in quality.score_quality(docs, empty).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_features_are_finite():
    for text in [None, "", " ", "\x00", "a", "é" * 10, "A\n\nA\n"]:
        assert np.isfinite(quality.features(text)).all() \
            and len(quality.features(text)) == len(quality.FEATURES)


def test_cut_is_a_quantile_of_all_labelled_documents(spark, monkeypatch):
    """However small the sample is; copies count in the quantile, and once in the sample."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        words = ["word"] * int(rng.integers(5, 40)) if i % 3 else ["!!!", "@#$"] * int(rng.integers(5, 40))
        rows.append((i, " ".join(words) + "."))
    rows += [rows[0]] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    sizes = []
    fit = quality.bradley_terry
    monkeypatch.setattr(quality, "bradley_terry", lambda v, g: (sizes.append(len(v)), fit(v, g))[1])
    model = quality.fit(docs, labels, F.lit(True), limit=40)
    assert 40 <= sizes[0] <= 120
    raw = sorted(quality.expanded((np.array([quality.features(t) for _, t in rows]) - model.mean) / model.scale)
                 @ model.weights)
    bad = sum(i % 3 == 0 for i, _ in rows)
    above = next(x for x in raw if x > raw[bad - 1])
    assert np.isclose(model.cut, (raw[bad - 1] + above) / 2)
    scores = {r.doc_id: r.quality_score for r in quality.score_quality(docs, model).collect()}
    assert all((s >= quality.CUT) == (i % 3 != 0) for i, s in scores.items())
    again = quality.fit(docs.orderBy("doc_id").repartition(2), labels, F.lit(True), limit=40)
    assert np.allclose(again.weights, model.weights) and again.cut == model.cut

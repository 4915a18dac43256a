"""Sentence borders learned from a corpus: published statistics, tokens, odd rows."""

import math
import time

import pytest
from pyspark.sql import functions as F

from variegate.operators import sentences as S

# Abbreviations stand before a full stop each time; other words end a sentence now and then.
TEXTS = ["Dr. Smith met Mrs. Jones on Monday. The talk was long. They ate, e.g. fish and rice.",
         "We saw Dr. Brown, i.e. the new head. The house is old. Mrs. Smith likes it.",
         "It costs much, e.g. ten. The fish was good (says Dr. Jones). They left.",
         "Ask Dr. Smith. The rice, e.g. with fish, is old. Mrs. Brown ate it. The end",
         "An old head left ten long boats here, and it was old and long, so ten men left"] * 12


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


@pytest.fixture(scope="module")
def model(corpus):
    return S.fit_sentences(corpus, "text")


def words(spark, text, model):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(S.trained_tokens(F.col("t"), model)).first()[0]


def split(spark, text, model):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(S.sentences(F.col("t"), model)).first()[0]


def test_abbreviations_and_starters_are_found(model):
    assert {"dr", "mrs", "e.g"} <= set(model.abbreviations)
    assert not {"fish", "old", "it", "long", "monday"} & set(model.abbreviations)
    assert "the" in model.starters and "smith" not in model.starters


def test_score_by_hand(corpus):
    rows = {r.type: r for r in S.abbreviation_statistics(corpus, "text").collect()}
    tokens = [t for text in TEXTS for t in text.split()]
    stops = sum(t.rstrip("),").endswith(".") for t in tokens)
    p = stops / len(tokens)

    def score(k, m, size, inner):
        alike = k * math.log(p + 1e-8) + m * math.log(1 - p + 1e-8)
        kind = k * math.log(0.99) + m * math.log(0.01)
        return 2 * (kind - alike) * math.exp(-size) * (inner + 1) * size ** -m

    assert (rows["e.g"].n_stop, rows["e.g"].n_plain) == (36, 0)
    assert rows["e.g"].score == pytest.approx(score(36, 0, 2, 1))
    assert (rows["old"].n_stop, rows["old"].n_plain) == (24, 24)
    assert rows["old"].score == pytest.approx(score(24, 24, 3, 0))
    assert rows["dr"].score == pytest.approx(score(48, 0, 2, 0))
    assert (rows["fish"].n_stop if "fish" in rows else 0) == 0


def test_tokens_as_published(spark, model):
    assert words(spark, "Dr. Smith ate, e.g. fish.", model) \
        == ["Dr.", "Smith", "ate", ",", "e.g.", "fish", "."]
    assert words(spark, "It is old. Mrs. Brown left.", model) \
        == ["It", "is", "old", ".", "Mrs.", "Brown", "left", "."]
    # a border behind an abbreviation: a frequent starter follows, or nothing
    assert words(spark, "He saw the Dr. The end", model) == ["He", "saw", "the", "Dr", ".", "The", "end"]
    assert words(spark, "(see Dr.)", model) == ["(", "see", "Dr", ".", ")"]
    assert words(spark, "ask Dr. smith", model) == ["ask", "Dr.", "smith"]


def test_without_a_model_words_are_as_before(spark):
    from variegate.functions.words import word_tokens

    texts = [t for t in TEXTS[:5]] + ["", " \n", "a.b. c... d?!", "\"Hi.\" he said."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for got, want in rows.select(S.trained_tokens(F.col("t"), S.SentenceModel()), word_tokens(F.col("t"))).collect():
        assert got == want


def test_sentences(spark, model):
    assert split(spark, TEXTS[0], model) == [
        "Dr. Smith met Mrs. Jones on Monday.", "The talk was long.", "They ate, e.g. fish and rice."]
    assert split(spark, "No end", model) == ["No end"]
    assert split(spark, "What? \"Yes.\" Dr. Who!", model) == ["What?", "\"Yes.\"", "Dr. Who!"]
    assert split(spark, "", model) == [] and split(spark, None, model) is None


def test_odd_tables(spark):
    schema = "text string, type string, token string"
    none = spark.createDataFrame([], schema)
    assert S.fit_sentences(none, "text") == S.SentenceModel()
    odd = spark.createDataFrame([(None, "x", "y"), ("", "x", "y"), ("...", "x", "y"), (". . .", "x", "y"),
                                 ("a. " * 5000, "x", "y")], schema)
    found = {r.type: r for r in S.abbreviation_statistics(odd, "text").collect()}
    assert set(found) == {"a"} and found["a"].n_stop == 5000
    S.fit_sentences(odd, "text")


def test_order_and_partitions_do_not_matter(spark, corpus, model):
    assert S.fit_sentences(corpus.orderBy(F.desc("id")).repartition(7), "text") == model


def test_long_texts_take_time_in_proportion(spark, model):
    """Each token once asked for the whole text's tokens again, so ten times the text took a hundred."""
    def seconds(n):
        df = spark.createDataFrame([("Dr. Smith met the men. " * n,)] * 2, "t string")
        began = time.perf_counter()
        found = df.select(F.size(S.sentences(F.col("t"), model)),
                          F.size(S.trained_tokens(F.col("t"), model))).collect()
        assert [tuple(r) for r in found] == [(n, 6 * n)] * 2
        return time.perf_counter() - began

    seconds(10)
    assert seconds(6000) < 10


def test_a_null_text_has_no_words(spark, model):
    assert words(spark, None, model) is None and split(spark, None, model) is None
    assert words(spark, "", model) == [] and split(spark, "", model) == []

"""The table function of scores against the DataFrame form, its errors and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from variegate.functions.words import whitespace_tokens
from variegate.operators import score_table
from variegate.operators.scoring import score

KEYS = ["task_idx", "query_idx"]


@pytest.fixture(scope="module")
def answers(spark):
    score_table.register_score_table(spark)
    rng = random.Random(2)
    words = "red blue paper boat weight door stop the a of".split()
    rows = []
    for q in range(12):
        for a in range(rng.randrange(0, 7)):
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))
            vector = [rng.gauss(0, 1) for _ in range(4)]
            rows.append((q % 3, q, a, text, vector))
    rows += [(0, 90, None, None, None), (0, 91, 0, "same words here", [1.0, 0.0, 0.0, 0.0]),
             (0, 91, 1, "Same words HERE", [2.0, 0.0, 0.0, 0.0]), (0, 92, 0, None, None), (0, 92, 4, "one", [0.0] * 4),
             (0, 93, 0, "", [1.0] * 4), (0, 93, 1, "", [-1.0] * 4), (1, 94, 0, "é\tü  x", [1.0] * 4)]
    df = spark.createDataFrame(rows, "task_idx int, query_idx int, answer_idx int, answer string, "
                                     "embedding array<double>")
    df.createOrReplaceTempView("answers_with_vectors")
    return df


def called(spark, text, keys="(task_idx, query_idx)"):
    return spark.sql(f"SELECT * FROM score(TABLE(answers_with_vectors) PARTITION BY {keys}, {text})")


def by_key(df):
    return {(r.task_idx, r.query_idx): r.score for r in df.collect()}


@pytest.mark.parametrize("method, arg_n", [("self_bleu", 1), ("self_bleu", 4), ("ncd", None),
                                           ("diversity", None), ("diversity", 2)])
def test_equals_the_dataframe_form(spark, answers, method, arg_n):
    options = {"tokenizer": whitespace_tokens} if method == "self_bleu" else {}
    expected = by_key(score(answers.where(F.col("answer_idx").isNotNull()), KEYS, method, arg_n,
                            queries=answers.select(*KEYS), **options))
    found = called(spark, f"'{method}'" + (f", {arg_n}" if arg_n else ""))
    assert found.columns == [*KEYS, "method", "arg_n", "score"]
    got = by_key(found)
    assert got.keys() == expected.keys() and len(got) > 10
    for key, value in expected.items():
        assert got[key] == pytest.approx(value, abs=1e-12), key
    assert {(r.method, r.arg_n) for r in found.collect()} == {(method, arg_n)}


def test_tokens_in_place_of_text(spark, answers):
    answers.withColumn("answer", whitespace_tokens(F.lower("answer"))).createOrReplaceTempView("tokens")
    found = spark.sql("SELECT * FROM score(TABLE(tokens) PARTITION BY (task_idx, query_idx), 'self_bleu', 2)")
    assert by_key(found) == by_key(called(spark, "'self_bleu', 2"))


def test_any_key_columns(spark, answers):
    spark.sql("SELECT task_idx AS `a b`, answer_idx, answer FROM answers_with_vectors WHERE query_idx = 91") \
        .createOrReplaceTempView("own")
    found = spark.sql("SELECT * FROM score(TABLE(own) PARTITION BY (`a b`), 'ncd')").collect()
    assert len(found) == 1 and found[0]["a b"] == 0


@pytest.mark.parametrize("text, message", [
    ("'nothing'", "no scoring method is named nothing"),
    ("'self_bleu'", "self_bleu needs arg_n, its longest n-gram")])
def test_errors_are_those_of_the_dataframe_form(spark, answers, text, message):
    with pytest.raises(Exception, match=message):
        called(spark, text).collect()
    method = text.strip("'")
    with pytest.raises(ValueError, match=message):
        score(answers, KEYS, method)


def test_other_errors(spark, answers, monkeypatch):
    with pytest.raises(Exception, match="partition by"):
        called(spark, "'ncd'", "(task_idx)").collect()
    with pytest.raises(Exception, match="columns missing"):
        spark.sql("SELECT * FROM score(TABLE(SELECT 1 AS x) PARTITION BY (x), 'ncd')").collect()
    twice = "SELECT 1 AS q, 0 AS answer_idx, 'a b' AS answer UNION ALL SELECT 1, 0, 'c'"
    with pytest.raises(Exception, match="two answers at position 0"):
        spark.sql(f"SELECT * FROM score(TABLE({twice}) PARTITION BY (q), 'self_bleu', 2)").collect()
    monkeypatch.setattr(score_table, "MOST_ANSWERS", 3)
    score_table.register_score_table(spark)
    with pytest.raises(Exception, match="over 3 answers"):
        called(spark, "'ncd'").collect()
    monkeypatch.undo()
    score_table.register_score_table(spark)


def test_empty_table(spark, answers):
    assert spark.sql("SELECT * FROM score(TABLE(SELECT * FROM answers_with_vectors WHERE false) "
                     "PARTITION BY (task_idx, query_idx), 'ncd')").count() == 0

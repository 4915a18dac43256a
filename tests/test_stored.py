"""Tables stored by query: no shuffle where they meet, and a run that is written twice."""

import uuid

import pytest
from pyspark.sql import functions as F

from variegate.operators import tasks
from variegate.operators.diversity import diversity_profile, diversity_score
from variegate.sources import schemas, stored, writers

SCHEMA = "task_idx int, query_idx int, answer_idx int, answer string, embedding array<double>"
KEYS = ["task_idx", "query_idx"]


@pytest.fixture
def names(spark):
    made = [f"t{uuid.uuid4().hex}" for _ in range(2)]
    yield made
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def answers(spark, tag, n=30):
    rows = [(q % 3, q, a, f"{tag} {q} {a}", [float(a + 1), float(q % 2)]) for q in range(n) for a in range(4)]
    return spark.createDataFrame(rows, SCHEMA)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_between_stored_tables(spark, names):
    vectors = writers.with_run(answers(spark, "x"), "e", "org/model", "emb").drop("answer")
    asked = spark.createDataFrame([(q % 3, f"t{q % 3}", "T", "p ", q, f"q{q}") for q in range(30)], schemas.TASKS)
    stored.store_by_query(vectors, names[0], 4)
    stored.store_by_query(asked, names[1], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = stored.stored(spark, names[0], env="e")
        joined = tasks.with_task_context(stored.stored(spark, names[1]), own)
        assert joined.count() == 120
        lengths = own.groupBy(*KEYS).agg(F.max("answer_idx"))
        for df in (joined, lengths, lengths.join(stored.stored(spark, names[1]), KEYS)):
            assert "Exchange" not in plan_of(df)
        scores = diversity_score(own, KEYS)
        assert "Exchange" not in plan_of(scores)
        assert {tuple(r) for r in scores.collect()} \
            == {tuple(r) for r in diversity_score(answers(spark, "x"), KEYS).collect()}
        assert "PartitionFilters: [isnotnull(env" in plan_of(own)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert diversity_profile(own, KEYS).count() == 30


def test_a_run_written_twice_has_its_rows_once(spark, names):
    for env, tag in (("a", "first"), ("b", "other"), ("a", "second")):
        stored.store_by_query(writers.with_run(answers(spark, tag, 5), env, "org/model"), names[0], 3)
    found = spark.table(names[0]).groupBy("env").agg(F.count("*").alias("n"), F.min("answer").alias("least"))
    assert {(r.env, r.n, r.least) for r in found.collect()} == {("a", 20, "second 0 0"), ("b", 20, "other 0 0")}
    with pytest.raises(ValueError, match="columns"):
        stored.store_by_query(answers(spark, "x"), names[0], 3)


def test_without_runs_and_without_rows(spark, names):
    stored.store_by_query(answers(spark, "x", 0), names[0], 3)
    assert stored.stored(spark, names[0]).count() == 0
    for tag in ("first", "second"):
        stored.store_by_query(answers(spark, tag, 2), names[0], 3)
    assert {r.answer.split()[0] for r in stored.stored(spark, names[0]).collect()} == {"second"}

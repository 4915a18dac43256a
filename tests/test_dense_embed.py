"""Dense vectors against NumPy's decomposition of the whole matrix, and odd texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from variegate.operators import dense_embed as d
from variegate.operators.diversity import diversity_profile

FEATURES = 512


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    topics = [[f"w{t}x{i}" for i in range(25)] for t in range(9)]
    out = []
    for i in range(400):
        own, size = topics[i % 9], rng.randrange(3, 30)
        out.append(" ".join(rng.choice(own if rng.random() < 0.8 else rng.choice(topics)) for _ in range(size)))
    return out


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(5)


def whole_matrix(df, n):
    rows = df.select("id", d.features_of(F.col("text"), FEATURES).alias("f")).collect()
    seen = Counter(f for r in rows for f in set(r.f))
    out = np.zeros((n, FEATURES))
    for r in rows:
        for f, c in Counter(r.f).items():
            out[r.id, f] = (1 + math.log(c)) * (1 + math.log((1 + n) / (1 + seen[f])))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def test_subspace_and_vectors_equal_the_whole_decomposition(df, texts):
    model = d.fit_dense(df, dimensions=8, features=FEATURES, rounds=60)
    matrix = whole_matrix(df, len(texts))
    _, values, right = np.linalg.svd(matrix, full_matrices=False)
    np.testing.assert_allclose(model.values, values[:8], rtol=1e-9)
    gap = np.linalg.norm(model.directions - right[:8].T @ (right[:8] @ model.directions), 2)
    assert gap < 1e-6
    found = d.dense_embedding(df, model).collect()
    vectors = np.array([r.embedding for r in sorted(found, key=lambda r: r.id)])
    np.testing.assert_allclose(vectors, matrix @ model.directions, atol=1e-12)


@pytest.mark.parametrize("fan", [2, 3])
def test_tree_of_factorisations(df, texts, monkeypatch, fan):
    monkeypatch.setattr(d, "FAN", fan)
    rows = df.select("id", "text", d.features_of(F.col("text"), FEATURES).alias("features"))
    weights = d.document_weights(rows, FEATURES)
    thin = np.random.default_rng(1).standard_normal((FEATURES, 6))
    triangle, back = d.range_pass(rows, weights, thin)
    matrix = whole_matrix(df, len(texts))
    product = matrix @ thin
    np.testing.assert_allclose(triangle.T @ triangle, product.T @ product, rtol=1e-10)
    np.testing.assert_allclose(back, matrix.T @ product, atol=1e-10)


def test_fewer_directions_than_asked_for(spark):
    few = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "c"), (3, None), (4, "")], "id int, text string")
    model = d.fit_dense(few, dimensions=8, features=64)
    assert model.directions.shape == (64, 2)
    found = {r.id: r.embedding for r in d.dense_embedding(few, model).collect()}
    assert found[3] is None and found[4] == [0.0, 0.0] and found[0] == found[1]
    assert np.dot(found[0], found[2]) == pytest.approx(0, abs=1e-12)


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "id int, text string, embedding string")
    model = d.fit_dense(none, features=32)
    assert model.directions.shape == (32, 0)
    assert d.dense_embedding(none, model).columns == ["id", "text", "embedding"]
    assert d.dense_embedding(none, model).count() == 0


def test_negative_cosines_reach_the_score(df):
    model = d.fit_dense(df, dimensions=8, features=FEATURES)
    vectors = d.dense_embedding(df, model).withColumn("group", F.col("id") % 4)
    profile = diversity_profile(vectors, ["group"], order="id").collect()
    assert all(r.score > 1 for r in profile) and sum(r.n_negative_pairs for r in profile) > 0


def test_a_pass_is_made_by_all_tasks_at_once(spark, monkeypatch):
    """What the driver iterates over is there before; it would run the tasks one after the other."""
    rows = spark.createDataFrame([([i % 5, i % 3],) for i in range(40)], "features array<int>").repartition(4)
    made = []
    own = d.cut_lineage
    monkeypatch.setattr(d, "cut_lineage",
                        lambda df: made.append(df.rdd.getNumPartitions()) or own(df))
    d.range_pass(rows, np.ones(5), np.eye(5)[:, :3])
    assert made == [4]

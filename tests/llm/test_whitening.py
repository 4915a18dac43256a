"""Whitening against a plain eigensolver, exact sums, and odd vectors."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import DATA

from variegate.llm import whitening as w
from variegate.llm.queries import op11_qdwh_whitening

SCHEMA = "vec_id long, embedding array<double>, n int, deviation string"


def spectra():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 7, 20, 64):
        a = rng.standard_normal((size + 3, size))
        yield a.T @ a
        a[:, :size // 2] = a[:, :1]  # copies of a dimension
        yield a.T @ a
        yield np.diag(np.round(rng.random(size) * 3))  # equal eigenvalues
        yield a.T @ a * 1e-12 + np.eye(size)
    yield np.diag([1e8, 1.0, 1e-8])
    yield np.zeros((3, 3))


@pytest.mark.parametrize("k", range(26))
def test_components_against_a_plain_solver(k):
    matrix = list(spectra())[k]
    values, vectors = w.components_of(matrix, 8)
    expected = np.sort(np.linalg.eigvalsh(matrix))[::-1][:8]
    expected = expected[expected > len(matrix) * w.EPS * max(expected[0], 0)]
    scale = max(np.linalg.norm(matrix), 1e-300)
    assert len(values) == len(expected)
    np.testing.assert_allclose(values, expected, atol=1e-13 * scale)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
    np.testing.assert_allclose(matrix @ vectors, vectors * values, atol=1e-13 * scale)


def test_polar_factor():
    a = np.random.default_rng(3).standard_normal((12, 12))
    a = a + a.T
    u = w.polar(a)
    np.testing.assert_allclose(u @ u, np.eye(12), atol=1e-13)
    assert (np.linalg.eigvalsh(u @ a) > 0).all()


def test_query_against_numpy(spark):
    found = op11_qdwh_whitening(spark, DATA).toPandas()
    table = pd.read_parquet(f"{DATA}/embeddings.parquet")
    x = np.floor(1024 * np.stack(table.embedding).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    z = x - sums / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = found.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    expected = z @ vectors[:, :8] / np.sqrt(values[:8])
    np.testing.assert_allclose(np.abs(white), np.abs(expected), atol=1e-8)
    exact = ((n * x - sums) ** 2).sum(1)
    assert (found.groupby("vec_id").deviation.first().loc[table.vec_id].to_numpy() == exact).all()
    np.testing.assert_allclose(found.groupby("component").explained.first(), values[:8] / values.sum())
    assert set(found.n) == {n} and found.identity_error.nunique() == 1
    assert found.identity_error[0] < 1e-10
    assert len(found) == 8 * n


def rows_of(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], SCHEMA).repartition(3)
    return w.whitened_components(df).collect()


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(30)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [math.nan, 1.0, 2.0]), (93, [1.0, math.inf, 2.0]), (94, [])]
    found = rows_of(spark, [*good, *bad, good[0], (None, good[1][1])])
    assert {r.vec_id for r in found} == {*range(30), None}
    assert {r.n for r in found} == {32} and {r.component for r in found} == {1, 2, 3}
    assert len([r for r in found if r.vec_id == 0]) == 6
    white = np.array([[r.whitened for r in sorted(found, key=lambda r: r.component) if r.vec_id == i]
                      for i in range(1, 30)])
    assert white.shape == (29, 3)


def test_other_dimensions_apart_and_flat_ones_left_out(spark):
    rng = np.random.default_rng(5)
    three = [(i, [*rng.standard_normal(2).tolist(), 0.5]) for i in range(20)]
    two = [(100 + i, rng.standard_normal(2).tolist()) for i in range(10)]
    found = rows_of(spark, three + two + [(200, [1.0])])
    assert {(r.n, r.component) for r in found if r.vec_id < 100} == {(20, 1), (20, 2)}
    assert {(r.n, r.component) for r in found if 100 <= r.vec_id < 200} == {(10, 1), (10, 2)}
    assert not [r for r in found if r.vec_id == 200]
    assert rows_of(spark, [(1, [1.0, 2.0])] * 5) == [] == rows_of(spark, [])


def test_large_numbers_stay_exact_or_null(spark):
    found = rows_of(spark, [(0, [5e5, 0.0]), (1, [-5e5, 1.0]), (2, [5.0, 2.0])])
    x = [[math.floor(1024 * v) + 100_000 for v in row] for row in ([5e5, 0.0], [-5e5, 1.0], [5.0, 2.0])]
    sums = [sum(c) for c in zip(*x)]
    exact = {i: sum((3 * v - s) ** 2 for v, s in zip(row, sums)) for i, row in enumerate(x)}
    assert {r.vec_id: r.deviation for r in found} == exact
    huge = rows_of(spark, [(0, [1e300]), (1, [0.0]), (2, [1.0])])
    assert {r.deviation for r in huge} == {None}

"""Nearest neighbours against all cosines."""

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from variegate.llm import neighbours as n
from variegate.llm.queries import op3_multiprobe

SCHEMA = "vec_id long, embedding array<float>, bucket int"


def exact(ids, vectors, query, k):
    """The k best of all rows but those of the query's id; ties to smaller ids."""
    vectors = np.array(vectors, float)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    own = units[ids.index(query)]
    scores = (units * own).sum(1)
    best = sorted((-round(s, 12), i) for s, i in zip(scores, ids) if i != query)[:k]
    return [i for _, i in best], [-s for s, _ in best]


def test_recall_and_scores_of_query(spark):
    found = op3_multiprobe(spark, DATA).toPandas()
    table = pd.read_parquet(f"{DATA}/embeddings.parquet")
    ids, vectors = table.vec_id.tolist(), np.stack(table.embedding)
    assert set(found.query_id) == {i for i in ids if i % 50 == 0}
    hits = 0
    for query, rows in found.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(rows.score) <= 0).all()
        hits += len(set(rows.vec_id) & set(exact(ids, vectors, query, 5)[0]))
        own = vectors[ids.index(query)].astype(float)
        for vec, score in zip(rows.vec_id, rows.score):
            other = vectors[ids.index(vec)].astype(float)
            cosine = own @ other / np.linalg.norm(own) / np.linalg.norm(other)
            assert score == pytest.approx(cosine, abs=1e-12)
    assert hits >= 0.9 * 5 * found.query_id.nunique()


def test_recall_of_clusters(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 24))
    vectors = (centers[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)
    found = n.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    hits = sum(len(set(rows.vec_id) & set(exact(list(range(4000)), vectors, q, 5)[0]))
               for q, rows in found.groupby("query_id"))
    assert hits >= 0.9 * 5 * 80


def test_copies_and_ties(spark):
    """A third of the rows is one vector: its copies are candidates, smallest ids first."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 == 0 else rng.normal(size=3).tolist(), 0) for i in range(900)]
    found = n.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append(r.vec_id)
    assert by_query[0] == [3, 6, 9, 12, 15] and by_query[150] == [0, 3, 6, 9, 12]
    assert all(len(v) == 5 and q not in v for q, v in by_query.items())


@pytest.mark.parametrize("times", [2, 6, 9])
def test_copies_in_repeated_rows(spark, times):
    """A row that is repeated does not hide the other copies of its vector."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 0.5], 0) for i in range(100, 112) for _ in range(times)]
    rows += [(i, rng.normal(size=3).tolist(), 0) for i in range(1, 90)]
    found = n.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 100).collect()
    by_rank = {r["rank"]: r.vec_id for r in found}
    assert [by_rank[i] for i in range(1, 6)] == [101, 102, 103, 104, 105]
    assert len(found) == 5 * times and all(r.score == pytest.approx(1) for r in found)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0),
            (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [3e38, 3e38], 0),
            (7, [1.0, 0.0, 0.0], 0), (None, [1.0, 1.0], 0), (50, [-1.0, 0.0], None), (50, [-1.0, 0.0], 0),
            (8, [1e-30, 0.0], 0)]
    found = n.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert by_query[0] == [(8, 1.0), (6, 0.707107), (50, -1.0)]
    assert by_query[50][0] == (6, -0.707107) and len(by_query[50]) == 2 * 3


def test_few_rows(spark):
    assert n.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 0)], SCHEMA)
    assert n.nearest(one, F.col("vec_id") % 50 == 0).count() == 0


def test_probes_are_in_order_of_success():
    tables = n.Tables(8, 4)
    units = n.unit(np.random.default_rng(0).normal(size=(5, 8)))
    cells, within = tables.cells(units)
    probes = tables.probes(units, 81)
    for t in range(n.TABLES):
        for i in range(5):
            moves = probes[t, i] - cells[t, i]
            cost = (np.where(moves == -1, within[t, i], 0) ** 2
                    + np.where(moves == 1, 1 - within[t, i], 0) ** 2).sum(1)
            assert (moves[0] == 0).all() and (np.diff(cost) >= -1e-12).all()
            assert len({tuple(m) for m in moves}) == 81


def test_projections_grow():
    assert [n.projections_for(r) for r in (0, 4000, 100_000, 400_000, 10**9)] == [4, 4, 4, 6, 13]


def test_moves_cross_few_borders_first():
    moves = n.moves_of(4, 3000)
    assert len(moves) == 81 and len({tuple(m) for m in moves}) == 81
    crossed = (n.moves_of(13, n.MOST_MOVES) != 0).sum(1)
    assert len(crossed) <= n.MOST_MOVES and (np.diff(crossed) >= 0).all() and crossed.max() == 3
    assert len(crossed) == sum(len(list(n.itertools.combinations(range(13), i))) * 2 ** i for i in range(4))


@pytest.mark.parametrize("first_rows, most", [(10, 3_000), (1, 60)])
def test_recall_with_more_projections(spark, monkeypatch, first_rows, most):
    """As for large tables; with too few perturbations for the goal there are fewer projections."""
    monkeypatch.setattr(n, "FIRST_ROWS", first_rows)
    monkeypatch.setattr(n, "MOST_MOVES", most)
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(30, 24))
    vectors = (centers[rng.integers(0, 30, 2500)] + 0.4 * rng.normal(size=(2500, 24))).astype(np.float32)
    assert n.projections_for(2500) > 8
    tables, probes = n.fitted(24, 2500, vectors.astype(float), 5)
    assert probes <= len(tables.moves) and (most > 60) == (tables.axes.shape[2] > 8)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)
    found = n.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    hits = sum(len(set(rows.vec_id) & set(exact(list(range(2500)), vectors, q, 5)[0]))
               for q, rows in found.groupby("query_id"))
    assert hits >= 0.9 * 5 * 50


def test_each_dimension_by_itself(spark):
    rng = np.random.default_rng(8)
    two = [(i, rng.normal(size=2).tolist(), 0) for i in range(40)]
    three = [(100 + i, rng.normal(size=3).tolist(), 0) for i in range(30)]
    df = spark.createDataFrame(two + three + [(200, [1.0], 0)], SCHEMA)
    found = n.nearest(df, F.col("vec_id") % 50 == 0).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append(r.vec_id)
    for rows, query in ((two, 0), (three, 100)):
        ids = [i for i, _, _ in rows]
        vectors = np.array([v for _, v, _ in rows], np.float32)
        assert set(by_query[query]) == set(exact(ids, vectors, query, 5)[0])
    assert set(by_query) == {0, 100}


def test_many_queries_without_enough_candidates(spark):
    """Over a thousand lonely queries are compared with all rows, in several parts."""
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(1300, 40)).astype(np.float32))]
    df = spark.createDataFrame(rows, SCHEMA)
    keyed = df.select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"),
                      F.xxhash64(F.lit(1), "embedding").alias("k2"))
    entries = keyed.withColumn("ids", F.array("vec_id"))
    found = n._merged(n._compared_with_all(keyed, entries, 40, 5), 5).join(keyed, ["k1", "k2"]).collect()
    assert len(found) == 1300
    ids, vectors = list(range(1300)), [v for _, v, _ in rows]
    for r in found[:40]:
        assert [x.row for x in r.best if x.row != r.vec_id][:5] == exact(ids, vectors, r.vec_id, 5)[0]

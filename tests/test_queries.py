"""Every query against SQL where there is some, else against a loop over the same data."""

import gzip
import subprocess
import sys
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import DATA, ROOT
from test_diversity import by_definition

import __spark_entry__
from variegate.operators.embed import hashed_embedding
from variegate.operators import diversity
from variegate.plans import catalog, corpus, oracles, reports


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def comparable(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def plain(value):
        if value is None or (isinstance(value, float) and np.isnan(value)):
            return None
        return value if isinstance(value, (bool, str)) else float(value)

    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    cursor = sql.execute(oracles.ORACLES[name])
    names = [column[0] for column in cursor.description]
    expected = comparable(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert comparable(df.columns, df.collect()) == expected


@pytest.fixture(scope="module")
def answers(spark):
    df = corpus.document_answers(corpus.table(spark, DATA, "documents"))
    return df.toPandas().sort_values(["doc_id", "answer_idx"])


def test_diversity_by_label(spark):
    vectors = corpus.table(spark, DATA, "embeddings").toPandas()
    found = catalog.diversity_by_label(spark, DATA).toPandas().set_index("label").score
    expected = vectors.groupby("label").embedding.apply(lambda v: by_definition(np.stack(list(v))))
    np.testing.assert_allclose(found.sort_index(), expected.sort_index(), atol=1e-6)


def test_diversity_documents(spark, answers):
    vectors = hashed_embedding(spark.createDataFrame(answers), "answer").toPandas()
    expected = vectors.groupby("doc_id").embedding.apply(lambda v: by_definition(np.stack(list(v))))
    found = catalog.diversity_documents(spark, DATA).toPandas().set_index("doc_id").score
    np.testing.assert_allclose(found.sort_index(), expected.sort_index(), atol=1e-5)


def test_context_diversity(spark):
    """Replies read with their question; conversations without one score 0."""
    turns = pd.read_parquet(f"{DATA}/conversations.parquet")
    found = catalog.context_diversity(spark, DATA).toPandas().set_index("query_idx").score
    assert set(found.index) == set(turns.conv_id)
    rows, empty = [], set(turns.conv_id)
    for conv, part in turns.groupby("conv_id"):
        asked = part[part.role == "user"].sort_values("turn").text
        query = asked.iloc[0] if len(asked) else ""
        for turn, text in part[part.role == "assistant"][["turn", "text"]].itertuples(index=False):
            rows.append((conv, turn, f"Q: Reply to this turn:  {query}\nA: {text}"))
            empty.discard(conv)
    vectors = hashed_embedding(spark.createDataFrame(rows, "q long, i long, text string")).toPandas()
    expected = vectors.groupby("q").embedding.apply(lambda v: by_definition(np.stack(list(v))))
    np.testing.assert_allclose(found[expected.index], expected, atol=1e-5)
    assert empty and (found[sorted(empty)] == 0).all()


def test_embedding_after_the_shuffle(spark):
    """The same scores by vectors made before, for small and for large groups."""
    answers = corpus.document_answers(corpus.table(spark, DATA, "documents")) \
        .where("answer IS NOT NULL")
    before = diversity.diversity_score(hashed_embedding(answers, "answer"), ["lang"], order="doc_id")
    for limit in (10**6, 100):
        after = diversity.diversity_score(
            answers, ["lang"], order="doc_id", text="answer", dense_limit=limit,
            embed=lambda rows: hashed_embedding(rows, "answer"))
        left, right = (df.toPandas().set_index("lang").score.sort_index() for df in (before, after))
        np.testing.assert_allclose(left, right, rtol=1e-8)


def distance(texts):
    data = [t.encode() for t in texts]
    sizes = [len(gzip.compress(d)) for d in data]
    values = [(len(gzip.compress(data[i] + data[j])) - min(sizes[i], sizes[j]))
              / max(sizes[i], sizes[j]) for i, j in combinations(range(len(data)), 2)]
    return float(np.mean(values)) if values else 0.0


def test_compression_distance(spark, answers):
    expected = answers.groupby("doc_id").answer.apply(lambda t: distance(list(t)))
    found = catalog.compression_distance_documents(spark, DATA).toPandas() \
        .set_index("doc_id").score
    np.testing.assert_allclose(found.sort_index(), expected.sort_index(), atol=1e-6)


def test_score_summary_and_report(spark, answers):
    """The two reports, again in pandas from the scores of each document."""
    keys = ["lang", "doc_id"]
    scores = reports.score_answers(
        corpus.document_answers(corpus.table(spark, DATA, "documents")), keys).toPandas()
    summary = catalog.score_summary(spark, DATA).toPandas()
    totals = summary[summary.is_total].set_index("method")
    means = scores.groupby("method").score.mean()
    np.testing.assert_allclose(totals["mean"].sort_index(), means.sort_index(), atol=1e-6)
    per_task = summary[~summary.is_total].set_index(["method", "lang"])["mean"].sort_index()
    np.testing.assert_allclose(per_task, scores.groupby(["method", "lang"]).score.mean()
                               .sort_index(), atol=1e-6)

    report = catalog.score_rating_report(spark, DATA).toPandas().set_index(["lang", "score"])
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    wide = scores.pivot_table(index=keys, columns="method", values="score").reset_index() \
        .merge(labels, on="doc_id")
    for lang, part in wide.groupby("lang"):
        for method in reports.METHODS:
            rho = part.quality.rank().corr(part[method].rank())
            found = report.loc[(lang, method), "zero_order_rho"]
            if np.isnan(rho):
                assert found is None or np.isnan(found)
            else:
                assert found == pytest.approx(rho, abs=1e-9)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert {"score", "rating", "zero_order_rho", "partial_rho", "n_used"} <= set(df.columns)
    assert df.count() == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_from_another_folder(tmp_path):
    """Tasks that run Python code need no copy of the package."""
    code = (f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
            "from pyspark.sql import SparkSession\n"
            "import __spark_entry__ as entry\n"
            "spark = SparkSession.builder.master('local[2]').getOrCreate()\n"
            f"for name in ('diversity_by_label', 'compression_distance_documents'):\n"
            f"    print(name, entry.queries()[name](spark, {DATA!r}).count())\n")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, text=True,
                          capture_output=True, timeout=300)
    assert "diversity_by_label 10" in done.stdout, done.stderr
    assert "compression_distance_documents 200" in done.stdout, done.stderr

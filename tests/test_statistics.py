import numpy as np
import pandas as pd
import pytest

from variegate.functions.significance import beta_tail, normal_quantile
from variegate.operators.statistics import (average_ranks, correlation_report, display_report,
                                            mean_ci, partial_spearman, spearman)
from pyspark.sql import functions as F

X = [1, 2, 3, 4, 4]
Y = [2, 2, 5, 4, 6]
Z = [3, 1, 4, 4, 9]


def frame(spark, rows, columns="k string, x double, y double, z double"):
    return spark.createDataFrame(rows, columns)


def test_quantile_and_p():
    assert normal_quantile(0.95) == pytest.approx(1.9599639845400536)
    assert beta_tail(5.0, 0.5, 10 / 14) == pytest.approx(0.0733880348)
    assert beta_tail(0.5, 0.5, 0.5) == pytest.approx(0.5)
    assert beta_tail(3.0, 0.5, 0.0) == 0.0
    assert beta_tail(3.0, 0.5, 1.0) == 1.0


def test_goldens(spark):
    df = frame(spark, [("a", *map(float, row)) for row in zip(X, Y, Z)])
    plain = spearman(df, "x", "y").first()
    assert plain["rho"] == pytest.approx(0.7894736842)
    assert (plain["n"], plain["n_used"]) == (5, 5)
    partial = partial_spearman(df, "x", "y", "z", ["k"]).first()
    assert partial["rho"] == pytest.approx(0.0897649552)
    report = correlation_report(df, ["y"], ["x"], "z").first()
    assert report["change"] == pytest.approx(0.0897649552 - 0.7894736842)
    assert report["change_percent"] == pytest.approx((0.0897649552 / 0.7894736842 - 1) * 100)


def test_two_sided_p(spark):
    """rho = 2 / sqrt(14) has t = 2 at 10 degrees of freedom."""
    from variegate.functions.significance import correlation_p

    df = spark.createDataFrame([(2 / 14 ** 0.5, 10)], "r double, df int")
    p = df.select(correlation_p(F.col("r"), F.col("df")).alias("p")).first()["p"]
    assert p == pytest.approx(0.0733880348)


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_ranks_do_not_depend_on_buckets(spark, partitions):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 400),
                        "x": np.where(rng.random(400) < 0.4, 0.0, rng.normal(size=400).round(1)),
                        "flag": rng.random(400) < 0.7})
    table = average_ranks(spark.createDataFrame(pdf), ["k"], {"x": {
        "all_rows": F.lit(True), "some": F.col("flag")}}, partitions).toPandas() \
        .rename(columns={"__value": "x"})
    ranks = pdf.assign(r=pdf.groupby("k").x.rank())
    some = pdf[pdf.flag].assign(s=lambda d: d.groupby("k").x.rank())
    expected = ranks.drop_duplicates(["k", "x"]).merge(
        some.drop_duplicates(["k", "x"])[["k", "x", "s"]], how="left", on=["k", "x"])
    both = expected.merge(table, on=["k", "x"])
    assert len(both) == len(table) == len(expected)
    np.testing.assert_allclose(both.all_rows, both.r)
    with_some = both[both.s.notna()]
    np.testing.assert_allclose(with_some.some, with_some.s)


def test_against_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 120), "x": rng.integers(1, 6, 120) * 1.0,
                        "y": rng.normal(size=120), "z": rng.normal(size=120)})
    pdf["y"] += pdf.x / 3
    pdf.loc[::17, "y"] = np.nan
    pdf.loc[::23, "z"] = np.nan
    rows = {r["k"]: r for r in correlation_report(
        frame(spark, list(pdf.itertuples(index=False, name=None))), ["y"], ["x"], "z",
        ["k"]).collect()}
    for k, part in pdf.groupby("k"):
        plain = part.dropna(subset=["x", "y"])
        full = part.dropna()
        r = full[["x", "y", "z"]].rank().corr()
        partial = (r.x.y - r.x.z * r.y.z) / np.sqrt((1 - r.x.z ** 2) * (1 - r.y.z ** 2))
        assert rows[k]["zero_order_rho"] == pytest.approx(plain.x.rank().corr(plain.y.rank()))
        assert rows[k]["partial_rho"] == pytest.approx(partial)
        assert (rows[k]["n"], rows[k]["n_used"]) == (len(part), len(full))
        assert 0 <= rows[k]["partial_p"] <= 1


def test_undefined(spark):
    df = frame(spark, [("same", 1.0, float(i), 0.0) for i in range(4)]
               + [("one", 1.0, 2.0, 3.0), ("none", None, 2.0, 3.0)]
               + [("up", float(i), float(i), float(i % 2)) for i in range(5)])
    rows = {r["k"]: r for r in correlation_report(df, ["y"], ["x"], "z", ["k"]).collect()}
    for k in ("same", "one", "none"):
        assert rows[k]["zero_order_rho"] is None and rows[k]["zero_order_p"] is None
    assert rows["none"]["n_used"] == 0
    assert rows["up"]["zero_order_rho"] == pytest.approx(1)
    assert rows["up"]["zero_order_p"] == pytest.approx(0)


def test_null_groups_are_kept(spark):
    df = frame(spark, [(None, float(i), float(i * i), 0.0) for i in range(4)])
    row = spearman(df, "x", "y", ["k"]).first()
    assert (row["k"], row["n_used"]) == (None, 4)
    assert row["rho"] == pytest.approx(1)


def test_independent_covariate_changes_little(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=2000)
    df = frame(spark, [("a", float(a), float(a + b), float(c)) for a, b, c in
                       zip(x, rng.normal(size=2000), rng.normal(size=2000))])
    report = correlation_report(df, ["y"], ["x"], "z").first()
    assert abs(report["change"]) < 0.01


def test_mean_ci(spark):
    df = frame(spark, [("a", 1.0, 0.0, 0.0), ("a", 3.0, 0.0, 0.0), ("b", 5.0, 0.0, 0.0)])
    rows = {r["k"]: r for r in mean_ci(df, "x", ["k"]).collect()}
    assert rows["a"]["mean"] == 2 and rows["a"]["margin"] == pytest.approx(1.959963984540054)
    assert rows["b"]["margin"] is None
    assert rows[None]["is_total"] and rows[None]["n"] == 3 and rows[None]["mean"] == 3
    total = mean_ci(df, "x").first()
    assert total["is_total"] and total["n"] == 3
    assert {r["k"] for r in mean_ci(df, "x", ["k"], total=False).collect()} == {"a", "b"}


def test_display(spark):
    df = spark.createDataFrame([("a", 0.123456)], "k string, v double")
    assert display_report(df).first()["v"] == 0.1235


def test_tail_at_many_degrees_of_freedom():
    from variegate.functions.significance import beta_tail
    n = 1e10
    x = 1 - (2 / (n + 4) ** 0.5) ** 2
    assert beta_tail(n / 2, 0.5, x) == pytest.approx(0.0455002639, abs=1e-7)


@pytest.mark.parametrize("rows", [100_000, 10])
def test_one_value_fills_most_rows(spark, monkeypatch, rows):
    """90 % of the rows hold one value; ranks are broadcast, and too many for that."""
    from variegate.operators import statistics
    monkeypatch.setattr(statistics, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": "a", "x": np.where(rng.random(2000) < 0.9, 0.0, rng.normal(size=2000)),
                        "y": rng.normal(size=2000), "z": rng.integers(0, 3, 2000) * 1.0})
    pdf["y"] += pdf.x
    found = spearman(spark.createDataFrame(pdf), "x", "y", ["k"]).first()
    assert found["rho"] == pytest.approx(pdf.x.rank().corr(pdf.y.rank()), abs=1e-12)
    assert found["n_used"] == 2000

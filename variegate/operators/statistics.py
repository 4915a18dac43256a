"""Means with intervals, ranks and rank correlations over keyed score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variegate.functions.significance import correlation_p, normal_quantile
from variegate.operators.grouping import BROADCAST_ROWS, null_safe_join
from variegate.session import cut_lineage

# Parts that rows of one value are spread over where ranks cannot be broadcast.
HOT_PARTS = 32


def mean_ci(df: DataFrame, value: str = "score", by: list[str] | None = None,
            total: bool = True, within: list[str] | None = None,
            confidence: float = 0.95) -> DataFrame:
    """Mean and normal-theory margin per group of ``by`` and, with ``total``, over all rows.

    ``is_total`` marks rows over all, one for each group of ``within``. The margin is null
    for a single value.
    """
    by, within = by or [], within or []
    rows = df.where(F.col(value).isNotNull())
    sums = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("sd")]
    outer, inner = [F.col(c) for c in within], [F.col(c) for c in by]
    if by and total:
        grouped = rows.groupingSets([outer + inner, outer], *outer, *inner).agg(
            *sums, (F.grouping_id() > 0).alias("is_total"))
    else:
        grouped = rows.groupBy(*outer, *inner).agg(*sums).withColumn("is_total", F.lit(not by))
    margin = normal_quantile(confidence) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return grouped.select(*within, *by, "is_total", "n", "mean", "sd", margin.alias("margin"))


def average_ranks(df: DataFrame, by: list[str], counted: dict[str, dict[str, Column]],
                  n_buckets: int) -> DataFrame:
    """``by, __name, __value`` and, for each set of rows, the average rank of the value in it.

    ``counted`` names, for each value column, the sets of rows among which it is ranked; the
    rank is null for sets of other columns. All columns go through together. Equal values are
    counted first, so a value that fills a third of the rows is one row here. The distinct
    values are then summed up in buckets: first within each bucket, then over the buckets'
    totals. No task sees all values of a group, and the result does not depend on where the cuts
    lie.
    """
    names = list(dict.fromkeys(name for sets in counted.values() for name in sets))
    stacked = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(v).alias("__name"), F.col(v).cast("double").alias("__value"), *[
            sets.get(name, F.lit(None).cast("boolean")).alias(name) for name in names])
        for v, sets in counted.items()]))).where(F.col("__value").isNotNull())
    keys = [*by, "__name"]
    histogram = cut_lineage(stacked.groupBy(*keys, "__value").agg(*[
        F.count(F.when(F.col(name), 1)).alias(name) for name in names]))
    bucket = F.lit(0)
    for v, cuts in _cuts(histogram, n_buckets).items():
        bucket = F.when(F.col("__name") == v, _cuts_below(F.col("__value"), cuts)) \
            .otherwise(bucket)
    placed = histogram.withColumn("__bucket", bucket)
    totals = placed.groupBy(*keys, "__bucket").agg(*[
        F.sum(name).alias(f"__{name}") for name in names])
    over_buckets = Window.partitionBy(*keys).orderBy("__bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__bucket", *[
        F.coalesce(F.sum(f"__{name}").over(over_buckets), F.lit(0)).alias(f"__{name}")
        for name in names])
    within = Window.partitionBy(*keys, "__bucket").orderBy("__value") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.select(*keys, "__value", "__bucket", *[
        (F.sum(name).over(within) - (F.col(name) - 1) / 2).alias(name) for name in names])
    return null_safe_join(ranked, starts, [*keys, "__bucket"]).select(*keys, "__value", *[
        (F.col(name) + F.col(f"__{name}")).alias(name) for name in names])


def _cuts(histogram: DataFrame, n_buckets: int) -> dict[str, list[float]]:
    """For each name, about ``n_buckets - 1`` of its distinct values at equal distances."""
    if n_buckets < 2:
        return {}
    fractions = F.array(*[F.lit(i / n_buckets) for i in range(1, n_buckets)])
    finite = histogram.where(F.abs("__value") < float("inf"))
    found = finite.groupBy("__name").agg(F.percentile_approx(
        "__value", fractions, max(10_000, 10 * n_buckets)).alias("cuts")).collect()
    return {row["__name"]: sorted(set(row["cuts"] or ())) for row in found}


def _cuts_below(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are below the value, by halving steps."""
    if not cuts:
        return F.lit(0)
    edges = F.array(*[F.lit(float(cut)) for cut in cuts])
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def advance(below: Column, step: Column) -> Column:
        reached = (below + step <= len(cuts)) & (F.get(edges, below + step - 1) < value)
        return F.when(reached, below + step).otherwise(below)

    return F.aggregate(F.array(*[F.lit(step) for step in steps]), F.lit(0), advance)


def with_ranks(df: DataFrame, by: list[str],
               counted: dict[str, dict[str, Column]]) -> DataFrame:
    """For each value, attach its average ranks as ``{name}_{value}``; ``df`` is a written table.

    The table of ranks has a row for each distinct value. It is broadcast if it is counted to be
    short; else rows and ranks meet in parts, so that a value of very many rows is in many tasks.
    """
    n_buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = cut_lineage(average_ranks(df, by, counted, n_buckets))
    short = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parts = 1 if short else HOT_PARTS
    ranked = df.withColumn("__part", F.monotonically_increasing_id() % parts)
    for value, sets in counted.items():
        own = table.where(F.col("__name") == value).select(
            *by, F.col("__value").alias(value),
            *[F.col(name).alias(f"{name}_{value}") for name in sets])
        each = own.withColumn("__part", F.explode(F.sequence(
            F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        ranked = null_safe_join(ranked, F.broadcast(each) if short else each,
                                [*by, value, "__part"], "left")
    return ranked.drop("__part")


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """``n, n_used, rho, p`` per group over the rows that hold both values."""
    return _correlations(df, [(x, y)], None, by or []).select(
        *(by or []), "n", F.col("n_plain").alias("n_used"), F.col("plain_rho").alias("rho"),
        correlation_p(F.col("plain_rho"), F.col("n_plain") - 2).alias("p"))


def partial_spearman(df: DataFrame, x: str, y: str, covariate: str,
                     by: list[str] | None = None) -> DataFrame:
    """``n, n_used, rho, p`` controlled for one covariate, over rows that hold all three."""
    return _correlations(df, [(x, y)], covariate, by or []).select(
        *(by or []), "n", F.col("n_partial").alias("n_used"), F.col("partial_rho").alias("rho"),
        correlation_p(F.col("partial_rho"), F.col("n_partial") - 3).alias("p"))


def correlation_report(df: DataFrame, scores: list[str], ratings: list[str] | None = None,
                       covariate: str = "answer_length",
                       by: list[str] | None = None) -> DataFrame:
    """Both correlations of every score with every rating, and the change between them."""
    pairs = [(rating, score) for score in scores for rating in ratings or ["flexibility"]]
    plain, partial = F.col("plain_rho"), F.col("partial_rho")
    change = partial - plain
    percent = F.when(plain == 0, 0.0).otherwise(F.try_divide(change, F.abs(plain)) * 100)
    return _correlations(df, pairs, covariate, by or []).select(
        *(by or []), F.col("y").alias("score"), F.col("x").alias("rating"),
        plain.alias("zero_order_rho"),
        correlation_p(plain, F.col("n_plain") - 2).alias("zero_order_p"),
        partial.alias("partial_rho"),
        correlation_p(partial, F.col("n_partial") - 3).alias("partial_p"),
        "n", F.col("n_partial").alias("n_used"),
        change.alias("change"), percent.alias("change_percent"))


def display_report(report: DataFrame) -> DataFrame:
    """Four digits, for reading."""
    return report.select(*[
        F.round(name, 4).alias(name) if kind == "double" else F.col(name)
        for name, kind in report.dtypes])


def _correlations(df: DataFrame, pairs: list[tuple[str, str]], z: str | None,
                  by: list[str]) -> DataFrame:
    """``by, x, y, n, n_plain, plain_rho, n_partial, partial_rho``: all pairs in one pass.

    Every value is ranked once, among the rows of each pair that it belongs to.
    """
    values = list(dict.fromkeys([v for pair in pairs for v in pair] + ([z] if z else [])))
    # Written once, with NaN as null, as several passes follow.
    rows = cut_lineage(df.select(*by, *[
        F.nullif(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in values]))
    counted: dict[str, dict[str, Column]] = {v: {} for v in values}
    found = []
    for i, (x, y) in enumerate(pairs):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        for v in (x, y):
            counted[v][f"plain_{i}"] = both
        rho = [F.count(F.when(both, 1)).alias("n_plain"),
               _rank_correlation(f"plain_{i}", both, x, y).alias("plain_rho")]
        if z is not None:
            every = both & F.col(z).isNotNull()
            for v in (x, y, z):
                counted[v][f"partial_{i}"] = every
            rho += [F.count(F.when(every, 1)).alias("n_partial"), *[
                _rank_correlation(f"partial_{i}", every, a, b).alias(name)
                for name, a, b in (("xy", x, y), ("xz", x, z), ("yz", y, z))]]
        found.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), *rho))
    grouped = with_ranks(rows, by, counted).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*found).alias("pairs"))
    result = grouped.select(*by, "n", F.inline("pairs"))
    if z is None:
        return result
    left = F.greatest((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2), F.lit(0.0))
    partial = F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt(left))
    return result.withColumn("partial_rho", partial)


def _rank_correlation(name: str, among: Column, a: str, b: str) -> Column:
    """Correlation of two columns of ranks; null if one of them is constant."""
    first = F.when(among, F.col(f"{name}_{a}"))
    second = F.when(among, F.col(f"{name}_{b}"))
    spread = F.stddev_pop(first) * F.stddev_pop(second)
    return F.try_divide(F.covar_pop(first, second), spread)

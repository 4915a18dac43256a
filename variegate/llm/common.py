"""What several of the operators share: reading, folds, checked broadcasts, row numbers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variegate.session import cut_lineage

# A side is broadcast only if it was counted and has at most this many rows of a few numbers.
BROADCAST_ROWS = 100_000


def lean_batches(spark: SparkSession) -> None:
    """Send fewer rows at once to Python, as texts are long; a number the user has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1000")


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, and at its end the memory it has used goes back to the system.

    Workers are used again by tasks of other stages; without this each would keep the most that any
    of them has needed.
    """
    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # a C library without it
                pass

    return tidied


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: read again, it is not computed again."""
    return cut_lineage(df)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast of ``df``, a written table, if it is counted to be short."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that a result is about to be named after."""
    return df.drop(*[c for c in df.columns if c in names])


def apart(df: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with its other columns renamed out of the way, and what brings the names back."""
    names = [c if c in needed else f"__x{i}" for i, c in enumerate(df.columns)]
    return (df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)]),
            [F.col(n).alias(c) for c, n in zip(df.columns, names)])


def numbered(df: DataFrame, shard: str, slot: str) -> DataFrame:
    """Number the rows of each shard without gaps from 0, in no task more than one partition.

    ``df`` must be a written table, whose partitions stay as they are. Rows are counted by
    shard and partition; the counts before a partition are where its numbers begin.
    """
    from pyspark.sql import Window

    # nondeterministic by Spark's reckoning, but fixed for a written table
    placed = df.withColumn("__row", F.monotonically_increasing_id()) \
        .withColumn("__part", F.shiftright("__row", 33))
    counts = placed.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("__shard"), F.col("__part").alias("__p"),
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, "__part").orderBy("__row")
    ranked = placed.withColumn("__rank", F.row_number().over(inside) - 1)
    return ranked.join(checked_broadcast(starts, 1_000_000),
                       (F.col(shard) == F.col("__shard")) & (F.col("__part") == F.col("__p"))) \
        .withColumn(slot, (F.col("__start") + F.col("__rank")).cast("long")) \
        .drop("__row", "__part", "__shard", "__p", "__start", "__rank")


def summed_before(df: DataFrame, shard: str, amount: str, name: str,
                  keep_rows: bool = False) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows of its shard that come before a row.

    ``df`` must be a written table, sorted over its partitions. Sums of partitions are added up by
    shard; within a partition and shard a window sums, so no task sees more than a partition.
    With ``keep_rows`` the result is written and keeps the order of ``df``.
    """
    from pyspark.sql import Window

    placed = df.withColumn("__row", F.monotonically_increasing_id()) \
        .withColumn("__part", F.shiftright("__row", 33))
    sums = placed.groupBy(shard, "__part").agg(F.sum(amount).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(shard).alias("__shard"), F.col("__part").alias("__p"),
                         F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, "__part").orderBy("__row") \
        .rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("__sum", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    out = within.join(checked_broadcast(starts, 1_000_000),
                      (F.col(shard) == F.col("__shard")) & (F.col("__part") == F.col("__p"))) \
        .withColumn(name, (F.col("__start") + F.col("__sum")).cast("long")) \
        .drop("__part", "__shard", "__p", "__start", "__sum")
    if keep_rows:
        return written(out.repartitionByRange("__row").sortWithinPartitions("__row").drop("__row"))
    return out.drop("__row")

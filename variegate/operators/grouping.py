"""Helpers shared by the grouped operators: first rows, group sizes, block pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from variegate.session import cut_lineage

# A side is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 100_000


def first_rows(df: DataFrame, keys: list[str], order: str, n: int | None) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    Spark cuts each group to ``n`` rows before the shuffle up to the threshold of
    ``windowGroupLimitThreshold``; beyond it, a salted first round does the same.
    """
    if n is None:
        return df
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > threshold:
        salt = F.pmod(F.xxhash64(order), F.lit(64))
        df = _ranked_up_to(df.withColumn("__salt", salt), [*keys, "__salt"], order, n) \
            .drop("__salt")
    return _ranked_up_to(df, keys, order, n)


def _ranked_up_to(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__rank", F.row_number().over(window)) \
        .where(F.col("__rank") <= n).drop("__rank")


@dataclass
class SizedGroups:
    """Rows of the small groups, and of the large ones with their group's size."""

    small: DataFrame
    large: DataFrame | None
    few: bool

    def join_large(self, rows: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
        """Attach one row per large group."""
        return null_safe_join(rows, F.broadcast(per_group) if self.few else per_group, keys)


def split_by_size(df: DataFrame, keys: list[str], limit: int) -> SizedGroups:
    """Part the rows by the size of their group, so that no task gets a group above ``limit``.

    Only the key columns are read for the sizes, and the count is combined before the
    shuffle. The list of large groups is counted before it is broadcast.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    large = sizes.where(F.col("group_size") > limit)
    found = large.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return SizedGroups(df, None, True)
    few = found <= BROADCAST_ROWS
    side = F.broadcast(large) if few else large
    return SizedGroups(null_safe_join(df, side.select(*keys), keys, "left_anti"),
                       null_safe_join(df, side, keys), few)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__{c}" if c in keys else c)
                             for c in right.columns])
    condition = reduce(Column.__and__,
                       [left[key].eqNullSafe(renamed[f"__{key}"]) for key in keys])
    return left.join(renamed, condition, how).drop(*[f"__{key}" for key in keys])


def with_places(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``__place``, from 0, in the order of the columns, which must tell its rows apart.

    Rows are sorted over all tasks and numbered in each; the counts of the tasks before, one for
    each, say where its numbers begin.
    """
    rows = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)) \
        .withColumn("__id", F.monotonically_increasing_id())
    part, counts = F.shiftright("__id", 33), {}
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        counts[r["part"]] = r["count"]
    starts, total = [], 0
    for p, n in counts.items():
        starts.append((p, total))
        total += n
    before = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    inside = F.col("__id").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(before), part == F.col("__part")) \
        .withColumn("__place", F.col("__start") + inside).drop("__id", "__part", "__start")


def scores_of(queries: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, score`` for every group listed in ``queries``; 0 for those without a row."""
    found = scores.withColumn("__found", F.lit(True))
    return null_safe_join(queries.select(*keys).distinct(), found, keys, "left").select(
        *keys, F.when(F.col("__found"), F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def pair_up_blocks(rows: DataFrame, block: Column, n_blocks: Column) -> DataFrame:
    """Send each row to every pair of blocks that holds its own block.

    All pairs of rows of a group then meet in some ``(low, high)``, in tasks of at most two
    blocks, without a row per pair.
    """
    other = F.explode(F.sequence(F.lit(0), n_blocks.cast("int") - 1)).alias("__other")
    spread = rows.withColumn("block", block.cast("int")).select("*", other)
    return spread.select(
        "*", F.least("block", "__other").alias("low"),
        F.greatest("block", "__other").alias("high")).drop("__other")


def key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(key, df.schema[key].dataType) for key in keys]


Kernel = Callable[[pa.Table], list[dict]]


def per_group(df: DataFrame, keys: list[str], fields: list[tuple[str, T.DataType]],
              kernel: Kernel) -> DataFrame:
    """Run ``kernel`` on each group as an Arrow table; it returns rows without the keys."""
    schema = T.StructType(key_fields(df, keys) + [T.StructField(*field) for field in fields])
    build = _row_builder(schema, keys)

    def run(group: pa.Table) -> pa.Table:
        name = tuple(group[key][0].as_py() for key in keys)
        return pa.Table.from_batches([build([(name, row) for row in kernel(group)])])

    return df.groupBy(*keys).applyInArrow(run, schema)


def per_small_group(df: DataFrame, keys: list[str], fields: list[tuple[str, T.DataType]],
                    kernel: Kernel, placed: bool = False) -> DataFrame:
    """The same for many groups of a few rows each, which share batches on the way to Python.

    A group must fit in memory, as it must for :func:`per_group`. ``placed`` says that the rows of
    a group lie in one partition already.
    """
    schema = T.StructType(key_fields(df, keys) + [T.StructField(*field) for field in fields])
    build = _row_builder(schema, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            done = []
            for name, part in runs_of_groups(batch, keys):
                if held and name != current:
                    done += [(current, row) for row in kernel(pa.concat_tables(held))]
                    held = []
                current = name
                held.append(pa.Table.from_batches([part]))
            yield build(done)
        if held:
            yield build([(current, row) for row in kernel(pa.concat_tables(held))])

    together = df if placed else df.repartition(*keys)
    return together.sortWithinPartitions(*keys).mapInArrow(run, schema)


def runs_of_groups(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple]:
    """The stretches of a batch with equal keys, each with its key."""
    names = list(zip(*[batch[key].to_pylist() for key in keys]))
    edges = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
    for start, end in zip([0, *edges], [*edges, len(names)]):
        if start < end:
            yield names[start], batch.slice(start, end - start)


def _row_builder(schema: T.StructType, keys: list[str]) -> Callable[[list], pa.RecordBatch]:
    types = to_arrow_schema(schema)

    def build(rows: list[tuple[tuple, dict]]) -> pa.RecordBatch:
        columns = [pa.array([name[i] for name, _ in rows], types.field(key).type)
                   for i, key in enumerate(keys)]
        columns += [pa.array([row[field.name] for _, row in rows], field.type)
                    for field in list(types)[len(keys):]]
        return pa.RecordBatch.from_arrays(columns, schema=types)

    return build

"""Normalised compression distance: the mean of (C(xy) - min) / max over the answers' pairs.

The concatenation is in answer order, which decides the result a little. Copies of a text
within a stretch of answers are kept as one unit with its positions, so that a pair of
texts is compressed once per order, however often it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variegate.functions.compression import gzip_len, gzip_size
from variegate.operators.grouping import (SizedGroups, pair_up_blocks, per_group,
                                          per_small_group, scores_of, split_by_size)

# Units of one block, and with it the most answers of a group that one task takes whole.
BLOCK = 128

# Answer positions that one unit may stand for.
STRETCH = 65_536

SUMS = [("total", T.DoubleType()), ("n_pairs", T.LongType())]


def compression_distance(df: DataFrame, keys: list[str], text: str = "answer",
                         order: str = "answer_idx", queries: DataFrame | None = None,
                         block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """``keys, score``; 0 for groups of fewer than two answers."""
    rows = df.where(F.col(text).isNotNull()) \
        .select(*keys, F.col(order).cast("long").alias("position"), F.col(text).alias("text"))
    groups = split_by_size(rows, keys, block)
    sums = _small_sums(groups.small, keys)
    if groups.large is not None:
        sums = sums.unionByName(_large_sums(groups, keys, block, stretch))
    scores = sums.groupBy(*keys).agg(F.sum("total").alias("total"),
                                     F.sum("n_pairs").alias("n_pairs")) \
        .select(*keys, F.when(F.col("n_pairs") == 0, 0.0)
                .otherwise(F.try_divide("total", "n_pairs")).alias("score"))
    return scores if queries is None else scores_of(queries, scores, keys)


def _small_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    def kernel(group: pa.Table) -> list[dict]:
        positions: dict[bytes, list[int]] = {}
        for position, text in zip(group["position"].to_pylist(), group["text"].to_pylist()):
            positions.setdefault(text.encode("utf-8"), []).append(position)
        units = [Unit(text, gzip_size(text), sorted(where)) for text, where in positions.items()]
        return [distance_sums(units, None)]

    # By a fixed number of partitions: the rows are few bytes for the time that their pairs take, and
    # would be put together by their bytes.
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return per_small_group(rows.repartition(partitions, *keys), keys, SUMS, kernel, placed=True)


def _large_sums(groups: SizedGroups, keys: list[str], block: int, stretch: int) -> DataFrame:
    part = F.floor(F.col("position") / stretch).alias("part")
    units = groups.large.groupBy(*keys, "text", part).agg(
        F.sort_array(F.collect_list("position")).alias("positions")) \
        .withColumn("size", gzip_len("text"))
    per_key = units.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias("n_blocks"))
    own = F.pmod(F.xxhash64("text", "part"), F.col("n_blocks"))
    pairs = pair_up_blocks(groups.join_large(units, per_key, keys), own, F.col("n_blocks"))

    def kernel(group: pa.Table) -> list[dict]:
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        sides: dict[int, list[Unit]] = {low: [], high: []}
        for row in group.select(["block", "text", "size", "positions"]).to_pylist():
            sides[row["block"]].append(
                Unit(row["text"].encode("utf-8"), row["size"], row["positions"]))
        return [distance_sums(sides[low], None if low == high else sides[high])]

    # By a fixed number of partitions, as the small groups are.
    columns = [*keys, "low", "high", "block", "text", "size", "positions"]
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pairs.select(*columns).repartition(partitions, *keys, "low", "high")
    return per_group(placed, [*keys, "low", "high"], SUMS, kernel).drop("low", "high")


class Unit:
    """One text, its compressed size and the positions where it stands."""

    def __init__(self, text: bytes, size: int, positions: list[int]):
        self.text = text
        self.size = size
        self.positions = np.asarray(positions, dtype=np.int64)

    def distance(self, other: Unit) -> float:
        joint = gzip_size(self.text + other.text)
        return (joint - min(self.size, other.size)) / max(self.size, other.size)

    def times_before(self, other: Unit) -> int:
        """Pairs of positions where this unit stands in front of the other."""
        return int(np.searchsorted(self.positions, other.positions).sum())


def distance_sums(units: list[Unit], others: list[Unit] | None) -> dict:
    """Sum over the pairs within ``units``, or between ``units`` and ``others``."""
    total, n_pairs = 0.0, 0
    for i, unit in enumerate(units):
        if others is None:
            copies = len(unit.positions)
            n_pairs += copies * (copies - 1) // 2
            if copies > 1:
                total += copies * (copies - 1) // 2 * unit.distance(unit)
        for other in units[i + 1:] if others is None else others:
            n_all = len(unit.positions) * len(other.positions)
            first = unit.times_before(other) if n_all > 1 \
                else int(unit.positions[0] < other.positions[0])
            n_pairs += n_all
            if first:
                total += first * unit.distance(other)
            if n_all - first:
                total += (n_all - first) * other.distance(unit)
    return {"total": total, "n_pairs": n_pairs}

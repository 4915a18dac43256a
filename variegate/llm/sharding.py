"""K-d tree partitioning: shards of near-equal bytes by splits along the widest dimension.

A node is split at a weighted quantile, the median where its shards halve evenly. The quantile is
found in two passes over histograms: one of the widest dimension, one of a hash of the text within
the bin that holds the cut. Only histograms reach the driver, a fixed number of bins per node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variegate.llm.common import checked_broadcast, numbered, written

BINS = 1024
FINE_BINS = 4096
# Copies of a text stay together, unless their bytes are over this part of a shard's.
GROUP_PART = 1 / 32

DIMENSIONS = ["lang", "source", "length", "position"]


def _unit(column: Column, seed: int) -> Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def metadata(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32``, a point in the unit cube, and the order of ties.

    Language and source become hashed places, length is logarithmic, and the position is the
    bits of the id reversed to a hash. Nulls are values like any other; a null text has no bytes
    and the checksum of an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(
        F.col("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.lit(1)).alias("text_hash"),
        _unit(F.coalesce(F.col("lang").cast("string"), F.lit("")), 2).alias("lang"),
        _unit(F.coalesce(F.col("source").cast("string"), F.lit("")), 3).alias("source"),
        F.least(F.log2(size.cast("double")) / 40, F.lit(1.0)).alias("length"),
        _unit(F.xxhash64(text), 4).alias("position"))
    return written(rows.withColumn("__row", F.monotonically_increasing_id()))


def _grouped(rows: DataFrame, target: float) -> DataFrame:
    """Give copies of a text one point and one place among ties; in a hot group, each its own."""
    groups = written(rows.groupBy("text_hash").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"),
        F.min("lang").alias("group_lang"), F.min("source").alias("group_source"))
        .where(F.col("copies") > 1).withColumnRenamed("text_hash", "group_hash").drop("copies"))
    joined = rows.join(checked_broadcast(groups), F.col("text_hash") == F.col("group_hash"), "left")
    hot = F.coalesce(F.col("bytes") > target * GROUP_PART, F.lit(False))
    alone = hot | F.col("group_hash").isNull()
    return joined.select(
        "doc_id", "size", "text_crc32", "length",
        F.when(alone, F.col("lang")).otherwise(F.col("group_lang")).alias("lang"),
        F.when(alone, F.col("source")).otherwise(F.col("group_source")).alias("source"),
        F.when(hot, _unit(F.col("__row"), 6)).otherwise(F.col("position")).alias("position"),
        F.when(hot, _unit(F.col("__row"), 5)).otherwise(_unit(F.col("text_hash"), 5)).alias("tie"))


def _choose(by_node: dict, default: Column) -> Column:
    chain = None
    for node, value in by_node.items():
        chain = F.when(F.col("node") == node, value) if chain is None \
            else chain.when(F.col("node") == node, value)
    return default if chain is None else chain.otherwise(default)


def kd_shards(docs: DataFrame, n_shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``.

    docs: doc_id, text, lang, source; further columns are not read. Sizes of shards differ by
    little more than the largest group of copies, which is at most ``GROUP_PART`` of a shard
    (larger groups are spread), or the largest text. An empty table gives no rows; repeated rows
    are rows of their own. Slots have no gaps and start at 0.
    """
    if n_shards < 1:
        raise ValueError(f"n_shards must be at least 1, not {n_shards}")
    points = metadata(docs)
    total = points.agg(F.sum("size")).first()[0] or 0
    rows = _grouped(points, total / n_shards).withColumn("node", F.lit(0))
    nodes = {0: (0, n_shards)}  # node: its first shard and how many it becomes
    while any(count > 1 for _, count in nodes.values()):
        rows = written(rows)
        split = {k: v for k, v in nodes.items() if v[1] > 1}
        cuts = _cuts(rows.where(F.col("node").isin(*split)), split)
        kept = {k: v for k, v in nodes.items() if v[1] == 1}
        nodes, moves = {}, {}
        for node, (first, count) in kept.items():
            nodes[first] = (first, 1)
            moves[node] = F.lit(first)
        for node, (first, count) in split.items():
            left = count // 2
            nodes |= {first: (first, left), first + left: (first + left, count - left)}
            if node in cuts:
                dimension, low, width, cut_bin, cut_fine = cuts[node]
                place = _bin(F.col(dimension), low, width)
                before = (place < cut_bin) | ((place == cut_bin) & (
                    F.floor(F.col("tie") * FINE_BINS) < cut_fine))
                moves[node] = F.when(before, first).otherwise(first + left)
        rows = rows.withColumn("node", _choose(moves, F.col("node")).cast("int"))
    shards = written(rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard")))
    return numbered(shards, "shard", "slot")


def _bin(value: Column, low: float, width: float) -> Column:
    if width <= 0:
        return F.lit(0)
    return F.least(F.floor((value - F.lit(low)) / F.lit(width) * BINS), F.lit(BINS - 1)).cast("int")


def _cuts(rows: DataFrame, split: dict) -> dict:
    """For each node: dimension, its range, the bin of the cut and the fine bin within it."""
    ends = [f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    widest = {}
    for row in rows.groupBy("node").agg(*ends).collect():
        spans = {d: row[f"{d}_high"] - row[f"{d}_low"] for d in DIMENSIONS}
        best = max(DIMENSIONS, key=lambda d: spans[d])
        widest[row["node"]] = (best, row[f"{best}_low"], spans[best])
    place = _choose({k: _bin(F.col(d), low, width) for k, (d, low, width) in widest.items()},
                    F.lit(0))
    placed = rows.withColumn("bin", place)
    coarse = {}
    for node, at, size in placed.groupBy("node", "bin").agg(F.sum("size")).collect():
        coarse.setdefault(node, {})[at] = size
    found = {}
    for node, sizes in coarse.items():
        goal = sum(sizes.values()) * (split[node][1] // 2) / split[node][1]
        at, before = _first_reaching(sizes, goal)
        found[node] = (at, goal - before)
    inside = _choose({k: F.col("bin") == at for k, (at, _) in found.items()}, F.lit(False))
    fine = {}
    shares = placed.where(inside).groupBy("node", F.floor(F.col("tie") * FINE_BINS).alias("fine")) \
        .agg(F.sum("size"))
    for node, at, size in shares.collect():
        fine.setdefault(node, {})[at] = size
    cuts = {}
    for node, (at, goal) in found.items():
        step, before = _first_reaching(fine[node], goal)
        over = before + fine[node][step] - goal
        cut = step + 1 if over < goal - before else step  # the nearer side
        cuts[node] = (*widest[node], at, cut)
    return cuts


def _first_reaching(sizes: dict[int, int], goal: float) -> tuple[int, int]:
    """The first bin with which the running sum reaches ``goal``, and the sum before it."""
    before = 0
    for at in sorted(sizes):
        if before + sizes[at] >= goal:
            return at, before
        before += sizes[at]
    last = max(sizes)
    return last, before - sizes[last]


def shards_for(total_bytes: int, target_bytes: int) -> int:
    """How many leaves of at most about ``target_bytes`` a table makes."""
    return max(1, math.ceil(total_bytes / target_bytes))

"""A trie of conversations' prefixes, with totals of subtrees by time-forward processing.

A node is a sequence of first turns; conversations that start with it are its members. Nodes are
dealt out to shards by their smallest member and depth and sorted in reverse level order there, so a
node comes after all of its descendants. Each sends its totals to its parent: within a shard
through a priority queue that spills to disk, to another shard as a message. Messages are added up
by parent and sent through the shards again, which are fewer and larger in each round, until none
is left. A parent's smallest member is never above its child's, and shards are ranges of it.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variegate.llm.common import checked_broadcast, numbered, written

BLOCK = 4096  # turns of a conversation that one window goes through
SHARD_NODES = 10_000
MOST_SHARDS = 4096
HOT_CHILDREN = 1000
BAND = 65_536  # depths of a shard
SHRINK = 3  # bits by which the number of shards falls from round to round
QUEUED = 200_000  # messages in memory; beyond, the queue is written out sorted
CHUNK = 1 << 20  # bytes of a list of ends in one row


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, at, role, text``: turns numbered from 0 within each conversation, written.

    turns: conv_id, turn, role, text. Null turns come first; of equal ones the order is that of role
    and text, and repeated rows are turns of their own. A null role or text becomes empty. Rows
    without a conv_id belong to no conversation and are left out. Rows are sorted over all tasks,
    so a conversation may hold any part of them.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return numbered(written(rows.repartitionByRange(*order).sortWithinPartitions(*order)),
                    "conv_id", "at").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with a shared beginning: ``conv_id, at, role, text`` and ``conv_id, size``.

    Conversation c is given the first h turns of conversation ``c - c % 5``, all of them if there are
    fewer, in place of its own first h, with h the CRC-32 of c in decimals modulo 9.
    """
    rows = written(ordered_turns(turns))
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("__own"))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    convs = written(sizes.withColumn("__head", head).withColumn("__base", base))
    known = convs.select(F.col("conv_id").alias("__of"), F.col("__own").alias("__there"))
    convs = written(convs.join(known, F.col("__base") == F.col("__of"), "left").select(
        "conv_id", "__base", "__head",
        F.least("__head", F.coalesce("__there", F.lit(0))).cast("long").alias("__shared"),
        F.greatest(F.col("__own") - F.col("__head"), F.lit(0)).alias("__rest")))
    # of at most five conversations, at most eight turns each
    first = rows.where((F.col("at") < 8) & (F.pmod("conv_id", F.lit(5)) == 0)) \
        .withColumnRenamed("conv_id", "__of")
    shared = convs.join(first, (F.col("__base") == F.col("__of")) & (F.col("at") < F.col("__head"))) \
        .select("conv_id", "at", "role", "text")
    kept = rows.where(F.col("at") >= head)
    # a conversation's own row is found by a join with its rows spread over salts, as one may be hot
    salt = F.pmod(F.hash("at"), F.lit(16))
    moved = convs.select("conv_id", "__shared", "__head",
                         F.explode(F.sequence(F.lit(0), F.when(F.col("__rest") > BLOCK, 15)
                                              .otherwise(0))).alias("__salt"), "__rest")
    own = kept.withColumn("__part", salt).join(
        checked_broadcast(moved.where(F.col("__rest") > BLOCK)
                          .select(F.col("conv_id").alias("__c"), "__salt",
                                  F.col("__shared").alias("__s"), F.col("__head").alias("__h"))),
        (F.col("conv_id") == F.col("__c")) & (F.col("__part") == F.col("__salt")), "left")
    long = own.where(F.col("__c").isNotNull()) \
        .select("conv_id", (F.col("at") - F.col("__h") + F.col("__s")).alias("at"), "role", "text")
    short = own.where(F.col("__c").isNull()).select("conv_id", "at", "role", "text") \
        .join(moved.where(F.col("__rest") <= BLOCK).drop("__salt", "__rest"), "conv_id") \
        .select("conv_id", (F.col("at") - F.col("__head") + F.col("__shared")).alias("at"),
                "role", "text")
    return (shared.union(long).union(short),
            convs.select("conv_id", (F.col("__shared") + F.col("__rest")).alias("size")))


def prefixes(turns: DataFrame) -> DataFrame:
    """Each prefix of each conversation as a row, the empty one apart: ``conv_id, depth, node, up``.

    A prefix is named by two 64-bit words, each the exclusive or of hashes of its turns with their
    places. Up to a block of turns goes through a window; blocks are chained by their totals.
    ``digest`` and ``bytes`` are the SHA-256 and the size of the last turn.
    """
    hashes = [F.xxhash64(F.lit(f"lane {i}"), "at", "role", "text") for i in (0, 1)]
    rows = turns.select(
        "conv_id", "at", hashes[0].alias("__x"), hashes[1].alias("__y"),
        F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)
        .alias("digest"), F.octet_length("text").cast("long").alias("bytes")) \
        .withColumn("__block", F.floor(F.col("at") / BLOCK).cast("long"))
    rows = written(rows)
    so_far = Window.partitionBy("conv_id", "__block").orderBy("at") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("__block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "__block").agg(F.bit_xor("__x").alias("__tx"),
                                                    F.bit_xor("__y").alias("__ty"))
    chained = totals.select(F.col("conv_id").alias("__c"), F.col("__block").alias("__b"),
                            F.bit_xor("__tx").over(before).alias("__bx"),
                            F.bit_xor("__ty").over(before).alias("__by")) \
        .where(F.col("__b") > 0)
    zero = F.lit(0).cast("long")
    inside = rows.withColumn("__sx", F.bit_xor("__x").over(so_far)) \
        .withColumn("__sy", F.bit_xor("__y").over(so_far))
    done = inside.join(checked_broadcast(written(chained)),
                       (F.col("conv_id") == F.col("__c")) & (F.col("__block") == F.col("__b")), "left") \
        .withColumn("__sx", F.col("__sx").bitwiseXOR(F.coalesce("__bx", zero))) \
        .withColumn("__sy", F.col("__sy").bitwiseXOR(F.coalesce("__by", zero)))
    return done.select(
        "conv_id", (F.col("at") + 1).alias("depth"),
        F.struct(F.col("__sx").alias("x"), F.col("__sy").alias("y")).alias("node"),
        F.struct(F.col("__sx").bitwiseXOR(F.col("__x")).alias("x"),
                 F.col("__sy").bitwiseXOR(F.col("__y")).alias("y")).alias("up"), "digest", "bytes")


def trie_nodes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each node, written: ``node, depth, up, conv_id, parent_conv_id, n_convs, bytes,
    n_children``. The root's ``up`` and ``parent_conv_id`` are null.

    That a name stands for one sequence is checked: all its rows must have one parent and one last
    turn, by SHA-256.
    """
    lone = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    roots = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), lone.alias("node"),
                         F.lit(None).cast("struct<x:bigint,y:bigint>").alias("up"),
                         F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    following = rows.union(roots)
    said = F.struct("up", "digest")
    nodes = following.groupBy("depth", "node").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.min("bytes").alias("bytes"), F.min(said).alias("__said"), F.max(said).alias("__last"))
    checked = F.when(F.col("__said").eqNullSafe(F.col("__last")), F.col("__said.up")) \
        .otherwise(F.raise_error(F.lit("two sequences of turns have one name")))
    nodes = written(nodes.select("depth", "node", "n_convs", "conv_id", "bytes", checked.alias("up")))
    kids = written(nodes.where(F.col("up").isNotNull())
                   .groupBy(F.col("up").alias("__up"), (F.col("depth") - 1).alias("__depth"))
                   .agg(F.count(F.lit(1)).alias("n_children")))
    nodes = written(nodes.join(kids, (F.col("node") == F.col("__up"))
                               & (F.col("depth") == F.col("__depth")), "left")
                    .select("depth", "node", "up", "n_convs", "conv_id", "bytes",
                            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")))
    # the parents of many children are few enough to be sent to them
    parents = nodes.where(F.col("n_children") > 0).select(
        F.col("node").alias("__up"), (F.col("depth") + 1).alias("__below"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__kids"))
    hot = written(parents.where(F.col("__kids") > HOT_CHILDREN))
    on = (F.col("up") == F.col("__up")) & (F.col("depth") == F.col("__below"))
    near = nodes.join(checked_broadcast(hot.withColumnRenamed("parent_conv_id", "__hot")), on, "left") \
        .drop("__up", "__below", "__kids")
    rest = parents.where(F.col("__kids") <= HOT_CHILDREN)
    found = near.where(F.col("__hot").isNotNull() | F.col("up").isNull()) \
        .withColumnRenamed("__hot", "parent_conv_id") \
        .unionByName(near.where(F.col("__hot").isNull() & F.col("up").isNotNull()).drop("__hot")
                     .join(rest, on).drop("__up", "__below", "__kids"))
    return written(found)


class SpillingQueue:
    """A priority queue of ``(key, totals)`` that writes itself out, sorted, when it is long.

    Runs are files of this task alone, without a name, so nothing of them outlives it.
    """

    def __init__(self, limit: int = QUEUED):
        self.limit, self.heap, self.runs, self.heads = limit, [], [], []

    def push(self, key: tuple, totals: tuple) -> None:
        heapq.heappush(self.heap, (key, totals))
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            # the order of the queue is kept by writing it from the least
            for item in sorted(self.heap):
                run.write(struct.pack("<qqqqq", *item[0], *item[1]))
            run.seek(0)
            self.heap = []
            self._advance(run)

    def _advance(self, run) -> None:
        raw = run.read(40)
        if raw:
            values = struct.unpack("<qqqqq", raw)
            heapq.heappush(self.heads, ((values[:3], values[3:]), id(run), run))
        else:
            run.close()

    def take(self, key: tuple) -> tuple[int, int]:
        """The sum of all totals for ``key``; all that is left must not be below it."""
        leaves = saved = 0
        while self.heap and self.heap[0][0] == key:
            _, (a, b) = heapq.heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.heads and self.heads[0][0][0] == key:
            (_, (a, b)), _, run = heapq.heappop(self.heads)
            leaves, saved = leaves + a, saved + b
            self._advance(run)
        return leaves, saved


def _forwarding(limit: int):
    """Rows of a shard in reverse level order, each node with the totals that arrive there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(limit), None
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in
                       ("shard", "depth", "x", "y", "up_x", "up_y", "up_shard", "leaves", "saved")]
            for at, depth, x, y, up_x, up_y, up_shard, leaves, saved in zip(*columns):
                if at != shard:
                    queue, shard = SpillingQueue(limit), at
                more = queue.take((-depth, x, y))
                leaves, saved = leaves + more[0], saved + more[1]
                inside = up_shard == at
                if (leaves or saved) and inside:
                    queue.push((1 - depth, up_x, up_y), (leaves, saved))
                out.append((leaves, saved, not inside))
            yield pa.RecordBatch.from_arrays(
                [batch["depth"], batch["x"], batch["y"], batch["up_x"], batch["up_y"],
                 pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.bool_())],
                names=["depth", "x", "y", "up_x", "up_y", "leaves", "saved", "crosses"])

    return run


def _placing(cuts: list[int]):
    """The range of the smallest member, a node's own and its parent's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(cuts, np.int64)
        for batch in batches:
            found = []
            for name in ("conv_id", "parent_conv_id"):
                ids = batch[name]
                at = np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
                found.append(pa.array(at.astype(np.int64),
                                      mask=ids.is_null().to_numpy(zero_copy_only=False)))
            kept = [c for c in batch.schema.names if c not in ("conv_id", "parent_conv_id")]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *found],
                                             names=[*kept, "__b", "__ub"])

    return run


FORWARDED = ("depth long, x long, y long, up_x long, up_y long, leaves long, saved long, "
             "crosses boolean")


def subtree_totals(nodes: DataFrame, shard_nodes: int = SHARD_NODES, band: int = BAND,
                   queued: int = QUEUED) -> DataFrame:
    """``depth, x, y, n_leaves, saved_tokens``: sums over the subtree of each node of ``nodes``.

    nodes: as :func:`trie_nodes` gives them. In the first round every node sends its own values, in
    later ones only what came from other shards moves, and only inner nodes take part. Shards are
    ranges of the smallest member, bounded by quantiles, and of depth. With each round there are
    eight times fewer, so the rounds are at most some logarithm of the shards.
    """
    count = nodes.count()
    shards = max(1, min(MOST_SHARDS, -(-count // shard_nodes)))
    cuts = []
    if shards > 1:
        cuts = nodes.agg(F.percentile_approx("conv_id", [i / shards for i in range(1, shards)],
                                             10 * shards)).first()[0]
        cuts = sorted(set(cuts))
    own = nodes.select(
        "depth", F.col("node.x").alias("x"), F.col("node.y").alias("y"), F.col("up.x").alias("up_x"),
        F.col("up.y").alias("up_y"), "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "conv_id", "parent_conv_id",
        F.floor(F.col("depth") / band).cast("long").alias("__d"),
        F.floor((F.col("depth") - 1) / band).cast("long").alias("__ud"))
    placed = written(own.mapInArrow(_placing(cuts), own.drop("conv_id", "parent_conv_id")
                                    .withColumns({"__b": F.lit(0).cast("long"),
                                                  "__ub": F.lit(None).cast("long")}).schema))
    none = F.lit(None).cast("long")

    def passed(rows: DataFrame, bits: int) -> DataFrame:
        def shard(b, d):
            return F.xxhash64(F.shiftright(b, bits), F.shiftright(d, bits))

        sent = rows.select(shard("__b", "__d").alias("shard"), "depth", "x", "y", "up_x", "up_y",
                           F.when(F.col("__ub").isNull(), none).otherwise(shard("__ub", "__ud"))
                           .alias("up_shard"), "leaves", "saved")
        order = ["shard", F.col("depth").desc(), "x", "y"]
        done = sent.repartition("shard").sortWithinPartitions(*order) \
            .mapInArrow(_forwarding(queued), FORWARDED)
        return written(done.where((F.col("leaves") != 0) | (F.col("saved") != 0)))

    found = passed(placed, 0)
    parts, bits = [found], 0
    while True:
        messages = written(found.where(F.col("crosses") & F.col("up_x").isNotNull())
                           .groupBy((F.col("depth") - 1).alias("__depth"), F.col("up_x").alias("__x"),
                                    F.col("up_y").alias("__y"))
                           .agg(F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved")))
        deepest = messages.agg(F.max("__depth")).first()[0]
        if deepest is None:
            break
        bits += SHRINK
        inner = placed.where((F.col("n_children") > 0) & (F.col("depth") <= deepest))
        arrived = inner.join(messages, (F.col("depth") == F.col("__depth")) & (F.col("x") == F.col("__x"))
                             & (F.col("y") == F.col("__y")), "left") \
            .withColumn("leaves", F.coalesce("__leaves", F.lit(0)).cast("long")) \
            .withColumn("saved", F.coalesce("__saved", F.lit(0)).cast("long"))
        found = passed(arrived, bits)
        parts.append(found)
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.groupBy("depth", "x", "y").agg(F.sum("leaves").alias("n_leaves"),
                                                F.sum("saved").alias("saved_tokens"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``depth, x, y, conv_id`` to joined stretches of the ids of a node, in order."""
    schema = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()),
                        ("first", pa.int64()), ("ids", pa.binary())])
    node, first, held, size = None, None, [], 0

    def stretch():
        return {"depth": node[0], "x": node[1], "y": node[2], "first": first, "ids": b",".join(held)}

    for batch in batches:
        out, room = [], 0
        for depth, x, y, conv_id in zip(*[batch[c].to_pylist() for c in ("depth", "x", "y", "conv_id")]):
            if node != (depth, x, y) or size > CHUNK:
                if held:
                    out.append(stretch())
                    room += size
                node, first, held, size = (depth, x, y), conv_id, [], 0
                if room > CHUNK:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, room = [], 0
            held.append(b"%d" % conv_id)
            size += len(held[-1]) + 1
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([stretch()], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in order to the SHA-256 of their join; only the state of one hash is held."""
    node, state = None, None
    names = ["__depth", "__x", "__y", "__sha"]

    def rows(out):
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0][i] for o in out], pa.int64()) for i in range(3)]
            + [pa.array([o[1] for o in out], pa.string())], names=names)

    for batch in batches:
        out = []
        for i in range(len(batch)):
            own = tuple(batch[c][i].as_py() for c in ("depth", "x", "y"))
            if own != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(batch["ids"][i].as_buffer())
        yield rows(out)
    if node is not None:
        yield rows([(node, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """``__depth, __x, __y, __sha``: for each node of ``ends(depth, x, y, conv_id)`` the SHA-256 of the
    ids that end there, ascending and joined by commas.

    Ids are sorted and joined over all tasks. A digest is made of one stretch after the other, so the
    joined text of a hot node passes a single task, a stretch of about a megabyte at a time.
    """
    order = ["depth", "x", "y", "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order) \
        .mapInArrow(_chunks, "depth long, x long, y long, first long, ids binary")
    return joined.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "first") \
        .mapInArrow(_digests, "__depth long, __x long, __y long, __sha string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node.

    turns: conv_id, turn, role, text; other columns are not looked at. Columns of the result:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Odd rows are treated as :func:`ordered_turns` says. Without any conversation there
    is no node, not even a root.
    """
    rows, sizes = rebuilt(turns)
    rows, sizes = written(prefixes(rows)), written(sizes)
    nodes = trie_nodes(rows, sizes)
    totals = subtree_totals(nodes)
    # a conversation ends at its last prefix, or at the root
    last = sizes.select(F.col("conv_id").alias("__c"), F.col("size").alias("__size"))
    at_end = rows.select("conv_id", "depth", "node").join(
        last, (F.col("conv_id") == F.col("__c")) & (F.col("depth") == F.col("__size"))) \
        .select("depth", F.col("node.x").alias("x"), F.col("node.y").alias("y"), "conv_id")
    zero = F.lit(0).cast("long")
    none = sizes.where(F.col("size") == 0).select(zero.alias("depth"), zero.alias("x"),
                                                  zero.alias("y"), "conv_id")
    digests = end_digests(at_end.union(none))
    here = nodes.withColumn("x", F.col("node.x")).withColumn("y", F.col("node.y"))
    empty = hashlib.sha256(b"").hexdigest()
    return here.join(totals, ["depth", "x", "y"], "left") \
        .join(digests, (F.col("depth") == F.col("__depth")) & (F.col("x") == F.col("__x"))
              & (F.col("y") == F.col("__y")), "left") \
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                F.coalesce("n_leaves", zero).alias("n_leaves"),
                F.coalesce("saved_tokens", zero).alias("saved_tokens"),
                F.coalesce("__sha", F.lit(empty)).alias("ends_sha256"))

"""The prefix trie against a plain one: rebuilding, totals, shards, digests, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from variegate.llm import tries as t

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs int"


def plain_trie(rows):
    """Rebuild each conversation, and ask every prefix who starts with it."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(own)] for c, own in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        own = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        saved[seq] = own + sum(saved[k] for k in kids[seq])
        leaves[seq] = sum(leaves[k] for k in kids[seq]) if kids[seq] else 1
    out = []
    for seq, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(seq))
        out.append((min(own), len(seq), min(members[seq[:-1]]) if seq else None, len(own), len(kids[seq]),
                    leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(partitions)
    return sorted(map(tuple, t.prefix_trie(df).collect()), key=str)


def some_turns():
    rng = random.Random(9)
    firsts = [f"hello {i} é" for i in range(3)]
    rows = []
    for c in [*range(0, 60), 1000, 1001, 77777, -3, -5]:
        for turn in range(rng.randrange(1, 12)):
            text = rng.choice(firsts) if turn < 2 else rng.choice(["yes", "no", "", f"own {c}"])
            rows.append((c, turn, ["user", "assistant"][turn % 2], text))
    rows += [(c, x, "user", f"again {x}") for c in range(200, 230) for x in range(10)]
    rows += [(300, None, "user", "first"), (300, 0, None, None), (300, 0, None, None), (301, 5, "", ""),
             (None, 0, "user", "no conversation"), (302, 1, "user", "b"), (302, 1, "user", "a"),
             (303, 0, "us", "er:x"), (304, 0, "user", ":x")]
    return rows


def test_against_a_plain_trie(spark):
    rows = some_turns()
    assert found(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("block", [1, 3])
def test_long_conversations_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(t, "BLOCK", block)
    monkeypatch.setattr(t, "HOT_CHILDREN", 1)
    rows = some_turns() + [(5000, i, "user", f"{i % 7}") for i in range(300)]
    assert found(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("shard_nodes, band, queued", [(4, 2, 1), (25, 1, 3), (10_000, 65_536, 2)])
def test_totals_over_many_shards_and_rounds(spark, shard_nodes, band, queued):
    rows = some_turns() + [(5000, i, "user", f"{i % 7}") for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    turns, sizes = t.rebuilt(df)
    nodes = t.trie_nodes(t.prefixes(turns), sizes)
    totals = t.subtree_totals(nodes, shard_nodes, band, queued)
    got = nodes.select("conv_id", "depth", F.col("node.x").alias("x"), F.col("node.y").alias("y")) \
        .join(totals, ["depth", "x", "y"], "left").fillna(0) \
        .select("conv_id", "depth", "n_leaves", "saved_tokens").collect()
    expected = [(r[0], r[1], r[5], r[6]) for r in plain_trie(rows)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_queue_spills_in_order():
    rng = random.Random(1)
    for limit in (1, 2, 7, 1000):
        queue, sums = t.SpillingQueue(limit), defaultdict(lambda: [0, 0])
        for _ in range(500):
            key = (rng.randrange(-5, 0), rng.randrange(-3, 3), 0)
            queue.push(key, (1, key[1]))
            sums[key][0] += 1
            sums[key][1] += key[1]
        for key in sorted({*sums, (-9, 0, 0), (5, 0, 0)}):
            assert list(queue.take(key)) == sums[key]


def test_hot_end_in_several_stretches(spark, monkeypatch):
    monkeypatch.setattr(t, "CHUNK", 50)
    rows = [(c, 0, "user", "hello") for c in range(0, 400)] + [(c, 1, "user", "so") for c in range(0, 400)]
    assert found(spark, rows, 5) == plain_trie(rows)


def test_one_name_for_two_sequences_is_an_error(spark):
    name = "struct(1L as x, 2L as y)"
    rows = spark.sql(f"SELECT 1L AS conv_id, 1L AS depth, {name} AS node, struct(0L as x, 0L as y) AS up, 'a' AS "
                     f"digest, 1L AS bytes UNION ALL SELECT 2L, 1L, {name}, struct(0L as x, 0L as y), 'b', 1L")
    sizes = spark.createDataFrame([(1, 1), (2, 1)], "conv_id long, size long")
    with pytest.raises(Exception, match="one name"):
        t.trie_nodes(rows, sizes).collect()


def test_empty_tables(spark):
    assert found(spark, []) == [] == found(spark, [(None, 1, "user", "x")])
    assert found(spark, [(5, None, None, None)]) == plain_trie([(5, None, None, None)])

"""Mixing by loops: targets, streams, schedule, taken words, odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from variegate.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, size string, target int"


def words(text):
    return len(re.findall("[^\x20\x09-\x0D]+", text or ""))


def targets_by_loop(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Give by weight, stop who is above, give the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while rest > 1e-9 and free:
        heavy = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / heavy
        rest = 0.0
        for s in [s for s in free if target[s] >= most * sizes[s]]:
            rest += target[s] - most * sizes[s]
            target[s] = float(most * sizes[s])
            free.discard(s)
    return target


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def taken_by_loop(rows, target, block):
    """Lay the words of a source out one by one and take its blocks in the order of the passes."""
    out = []
    by = defaultdict(list)
    for doc, text, source in rows:
        by[source].append((md5(f"{'' if doc is None else doc}:{md5(text or '')}"), doc, text))
    for source, docs in by.items():
        docs.sort(key=lambda d: (d[0], d[1] or 0))
        stream = [i for i, (_, _, text) in enumerate(docs) for _ in range(words(text))]
        blocks = [stream[i:i + block] for i in range(0, len(stream), block)]
        left, got = math.floor(target[source]), Counter()
        for p in range(2):
            for b in sorted(range(len(blocks)), key=lambda b: (md5(f"{p}:{b}"), b)):
                part = blocks[b][:left]
                got.update(part)
                left -= len(part)
        out += [(doc, words(text), got[i]) for i, (_, doc, text) in enumerate(docs)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), rng.choice(["a", "b", "c", "ä", "hot", "hot"]))
           for i in range(150)]
    out += [(200, None, "a"), (201, "", "b"), (202, "x\t\n y\x0b\x85z", None), (203, "w " * 5000, "c"),
            (204, "only", "tiny"), (205, None, "none"), (None, "no id here", "b"), out[0], out[0],
            (206, "other text", "b"), (206, "another text", "b")]
    return out


@pytest.mark.parametrize("block", [1, 7, 512])
def test_taken_by_loop(spark, rows, block):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    found = m.taken_words(docs, block=block).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    target = targets_by_loop(sizes)
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 2 * r["size"]
    by_source = Counter()
    for r in found:
        by_source[r.source] += r.taken
    assert by_source == {s: math.floor(t + 1e-9) for s, t in target.items()}
    assert sorted([(r.doc_id, r["size"], r.taken) for r in found], key=str) == taken_by_loop(rows, target, block)


def test_reruns_and_partitions_agree(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    first, second = (sorted(map(str, m.taken_words(d, block=16).collect()))
                     for d in (docs.repartition(3), docs.orderBy(F.desc("text")).repartition(8)))
    assert first == second


def test_schedule_is_spread(spark):
    slots = {0: 500, 1: 250, 2: 1, 3: 3000, 9: 2}
    uses = spark.createDataFrame(list(slots.items()), "source_no long, slots long")
    found = m.schedule(uses).collect()
    total = sum(slots.values())
    assert sorted(r.slot for r in found) == list(range(total))
    ranks = defaultdict(list)
    for r in sorted(found, key=lambda r: r.slot):
        ranks[r.source_no].append(r["rank"])
    assert all(own == list(range(len(own))) for own in ranks.values())
    # any stretch of the mix has the shares of the whole, but for a few slots
    for low, high in ((0, 100), (1000, 1500), (3000, total)):
        counts = Counter(r.source_no for r in found if low <= r.slot < high)
        for source, n in slots.items():
            assert abs(counts[source] - (high - low) * n / total) < 4
    # the points are those of the golden ratio
    golden = (5 ** 0.5 - 1) / 2
    bounds, at = [], 0
    for source in sorted(slots):
        bounds.append((at * m.F47 // total / m.F47, source))
        at += slots[source]
    for r in found:
        point = r.slot * golden % 1
        expected = max(b for b in bounds if b[0] <= point)
        if all(abs(point - b[0]) > 1e-6 for b in bounds):
            assert r.source_no == expected[1]


def test_many_tiny_sources_share_a_cell(spark):
    uses = spark.createDataFrame([(i, 1) for i in range(3000)] + [(3000, 40_000)],
                                 "source_no long, slots long")
    counts = Counter(r.source_no for r in m.schedule(uses).collect())
    assert sum(counts.values()) == 43_000 and abs(counts[3000] - 40_000) < 10
    assert set(counts) <= set(range(3001))


def test_mix_rows_name_the_words(spark, rows):
    docs = m.keyed(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    targets = m.source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    found = m.mix(docs, targets, block=20).collect()
    size = {r.doc_id: r["size"] for r in docs.collect() if r.doc_id not in (None, 0, 206)}
    for r in found:
        assert 0 < r.words <= 20 and r.from_word >= 0
        if r.doc_id in size:
            assert r.from_word + r.words <= size[r.doc_id]
    places = defaultdict(set)
    for r in found:
        places[r.late, r.slot if not r.late else (r.source_no, r.slot)].add((r.source_no, r["pass"], r.block))
    assert all(len(p) == 1 for p in places.values())  # a slot is one block of one source


def test_empty_table_and_no_words(spark):
    assert m.taken_words(spark.createDataFrame([], SCHEMA)).count() == 0
    found = m.taken_words(spark.createDataFrame([(1, " ", "a", "", 1), (2, None, None, "", 1)], SCHEMA)).collect()
    assert {(r.doc_id, r["size"], r.target, r.taken) for r in found} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_more_sources_than_are_broadcast(spark):
    """Documents and sources then meet by a join in parts; a third of the rows has one source."""
    docs = spark.range(150_000).select(
        F.col("id").alias("doc_id"), F.lit("two words").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"))
    found = m.taken_words(docs).groupBy("source", "source_size", "target").agg(
        F.sum("taken").alias("taken"), F.count("*").alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    rows = found.collect()
    assert len(rows) == 100_001 and sum(r.n for r in rows) == 150_000
    assert all(r.taken == math.floor(r.target) and r.over <= 0 for r in rows)
    assert sum(r.target for r in rows) == pytest.approx(1.5 * 300_000)

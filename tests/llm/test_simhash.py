"""Fingerprints and components against definitions."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from variegate.llm import simhash as s
from variegate.llm.components import connected


def by_definition(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One TWO", "a b c", "a b c d a b c d a b c",
                                  "É\u00a0x ÀB\x0bc\u2028d e", "w " * 200_000])
def test_fingerprint(text):
    assert s.fingerprint(text) == by_definition(text)


def test_spark_hashes_alike(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h & s.ALL_BITS == xxhash.xxh64_intdigest(b"a b c", 42)


def roots_by_hand(prints):
    prints = np.array(prints, np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.arange(len(prints))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(prints))])
        if (new == label).all():
            return label
        label = new


def near_prints(rng, centers, copies):
    out = set()
    for _ in range(centers):
        value = rng.getrandbits(64)
        for _ in range(copies):
            value ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3)))
            out.add(value & s.ALL_BITS)
    return sorted(out)


@pytest.mark.parametrize("large", [s.LARGE, 8])
def test_components_of_links(spark, large):
    """Chains of near fingerprints; with a small limit the shared bits are cut several times."""
    prints = near_prints(random.Random(large), 12, 25)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "__fp long")
    links = s.linked_pairs(df, large)
    for a, b in links.collect():
        assert ((a ^ b) & s.ALL_BITS).bit_count() <= 64
    roots = {r.node: r.root for r in connected(links).collect()}
    expected = roots_by_hand(prints)
    groups, found = {}, {}
    for i, p in enumerate(signed):
        groups.setdefault(expected[i], set()).add(p)
        found.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_pivots_discard_and_popcount_decides():
    prints = np.array(near_prints(random.Random(1), 5, 40), np.uint64)
    at = np.stack([np.bitwise_count(prints ^ np.uint64(p)) for p in s.PIVOTS], 1).astype(np.int16)
    roots = s.spanning_roots(prints, at)
    expected = roots_by_hand(prints)
    assert len(set(zip(roots, expected))) == len(set(roots)) == len(set(expected))


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in connected(links).collect()} == {0}


TEXT = " ".join(f"w{i}" for i in range(300))
ROWS = [(5, TEXT), (3, TEXT), (9, TEXT.upper()), (7, TEXT + " more"), (None, TEXT), (1, None), (2, ""),
        (4, "  "), (6, "alone here now"), (6, "alone here now"), (8, "x " * 100_000)]


def test_rows_with_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, root string")
    found = s.near_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    components = {(r.doc_id, r.component_id) for r in found}
    assert {(5, 3), (3, 3), (9, 3), (None, 3), (1, 1), (2, 1), (4, 1), (6, 6), (8, 8)} <= components
    kept = s.keep_one(docs.withColumn("__fp2", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        {r.component_id for r in found})
    assert kept.columns == ["doc_id", "text", "root", "__fp2"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.near_duplicates(docs).count() == 0
    assert s.keep_one(docs).count() == 0

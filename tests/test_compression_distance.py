import gzip
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from variegate.functions.compression import gzip_len, gzip_size
from variegate.operators.compression_distance import compression_distance


def by_definition(texts):
    sizes = [len(gzip.compress(t.encode())) for t in texts]
    values = [(len(gzip.compress((texts[i] + texts[j]).encode())) - min(sizes[i], sizes[j]))
              / max(sizes[i], sizes[j]) for i, j in combinations(range(len(texts)), 2)]
    return float(np.mean(values)) if values else 0.0


def frame(spark, groups):
    return spark.createDataFrame([(k, i, t) for k, texts in groups.items()
                                  for i, t in enumerate(texts)],
                                 "k string, answer_idx int, answer string")


GROUPS = {
    "golden": ["use it as a paperweight", "use it as a doorstop"],
    "tiny": ["aaaa", "aaaa"],
    "one": ["alone"],
}


def test_goldens(spark):
    found = {r["k"]: r["score"] for r in compression_distance(frame(spark, GROUPS), ["k"]).collect()}
    assert found == pytest.approx({"golden": 0.3255813953, "tiny": -0.0416666667, "one": 0.0})


def test_sizes(one):
    assert gzip_size(b"") == 20 and gzip_size(b"abc") == 23
    assert one(gzip_len(F.col("t")), t="abc") == 23
    assert one(gzip_len(F.col("t")), t=None) is None


def test_empty_group(spark):
    listed = spark.createDataFrame([("none",), ("one",)], "k string")
    rows = compression_distance(frame(spark, GROUPS), ["k"], queries=listed).collect()
    assert {r["k"]: r["score"] for r in rows} == {"none": 0.0, "one": 0.0}


def test_blocks_and_copies(spark):
    """Groups in blocks, with copies all over, give what a loop over all pairs gives."""
    rng = np.random.default_rng(7)
    pool = [" ".join(rng.choice(["red", "boat", "über", "x", "lamp"], size=rng.integers(1, 12)))
            for _ in range(25)]
    groups = {"mixed": list(rng.choice(pool, size=60)), "distinct": sorted(set(pool)),
              "copies": ["the same text"] * 40, "small": pool[:4],
              "hot": list(np.where(rng.random(50) < 0.7, "hot text here", rng.choice(pool, 50)))}
    found = {r["k"]: r["score"] for r in compression_distance(
        frame(spark, groups), ["k"], block=6, stretch=16).collect()}
    assert found == pytest.approx({k: by_definition(t) for k, t in groups.items()}, abs=1e-12)


def test_small_groups_keep_their_partitions(spark, capsys):
    """The few bytes of small groups, whose pairs take long, are not put together in fewer tasks."""
    compression_distance(frame(spark, GROUPS), ["k"]).explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_pairs_of_blocks_keep_their_partitions(spark, capsys):
    """Nor are those of large groups."""
    groups = {"large": [f"text {i}" for i in range(9)]}
    compression_distance(frame(spark, groups), ["k"], block=4).explain()
    plan = capsys.readouterr().out
    assert re.search(r"hashpartitioning\(k#\d+, low#\d+, high#\d+, 4\), REPARTITION_BY_NUM", plan)

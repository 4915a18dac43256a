"""Shards: sizes, slots, groups, odd rows."""

import zlib

import pandas as pd
from conftest import DATA

from variegate.llm import sharding
from variegate.llm.queries import op7_kd_sharding

SCHEMA = "doc_id long, text string, lang string, source string, node int"


def test_query_law(spark):
    found = op7_kd_sharding(spark, DATA).toPandas()
    texts = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id").text
    assert sorted(found.doc_id) == sorted(texts.index)
    for row in found.itertuples():
        raw = texts[row.doc_id].encode()
        assert (row.size, row.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert set(found.shard) <= set(range(16)) and set(found.law) == {"bytes"}
    for _, slots in found.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_even_sizes_and_small_groups_together(spark):
    rows = [(i, f"text {i % 4000} " + "x" * (i % 4000 % 90), f"l{i % 3}", f"s{i % 7}", 0)
            for i in range(8000)]
    found = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 16).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() < 1.08 * sizes.mean()
    assert (found.groupby("text_crc32").shard.nunique() == 1).all()


def test_hot_group_is_spread(spark):
    rows = [(i, "same text for all" if i % 3 else f"own {i}", "en", "s", 0) for i in range(6000)]
    found = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 8).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.1 * sizes.mean()


def test_any_number_of_shards(spark):
    rows = [(i, f"t{i}" * (i % 5), None, None, 0) for i in range(700)]
    found = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 5).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert sorted(sizes.index) == list(range(5)) and sizes.max() < 1.2 * sizes.mean()


def test_odd_rows(spark):
    rows = [(None, None, None, None, 1), (1, "", "en", None, 1), (1, "", "en", None, 1),
            (2, "y" * 500_000, "fr", "s", None)]
    found = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert sorted(r["size"] for r in found) == [1, 1, 1, 500_001]
    assert {r.text_crc32 for r in found if r["size"] == 1} == {0}
    assert sharding.kd_shards(spark.createDataFrame([], SCHEMA), 4).count() == 0
    assert sharding.shards_for(100, 30) == 4 and sharding.shards_for(0, 30) == 1

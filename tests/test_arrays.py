"""Nested arrays read by blocks, against the JSON module; broken ones; parts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from variegate.sources import arrays, readers


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def items(doc, level, at=()):
    for i, item in enumerate(doc):
        if level == 1:
            yield (*at, i), item
        else:
            yield from items(item, level - 1, (*at, i))


def read(spark, path, level):
    return {tuple(r.at): json.loads(r.item) for r in arrays.read_items(spark, str(path), level).collect()}


def test_piece_shapes():
    assert arrays.piece_shape('[["a') == (1, 2, 0)
    assert arrays.piece_shape(']"}]') == (1, -1, -2)
    assert arrays.piece_shape(r'"a\"]\\" ]') == (2, -1, -1)
    assert arrays.piece_shape("]]") == (0, -2, 0)


@pytest.mark.parametrize("seed", range(4))
def test_any_text_any_blocks(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)

    def text():
        return "".join(rng.choice('ab,[]{}"\\ü\n :') for _ in range(rng.randrange(12)))

    doc = [[[text() for _ in range(rng.randrange(4))] for _ in range(rng.randrange(4))]
           for _ in range(40)]
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=[None, 2][seed % 2], ensure_ascii=seed % 3 == 0),
                    encoding="utf-8")
    assert arrays._pieces(spark, str(path)).rdd.getNumPartitions() > 3
    for level in (1, 2, 3):
        assert read(spark, path, level) == dict(items(doc, level))


def test_an_item_over_many_blocks(spark, tmp_path, small_blocks):
    doc = [{"a": ["x,y" * 500, "[" * 300]}, {"b": None}, {"c": list(range(900))}]
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc))
    assert read(spark, path, 1) == dict(items(doc, 1))


def test_parts_make_up_one_document(spark, tmp_path, small_blocks):
    text = json.dumps([[["a,b", "c]"], []], [], [["d", "é\"" * 90]]], ensure_ascii=False)
    for cuts in ([3, 9], [1, 2, 14, 15], [len(text) - 1]):
        folder = tmp_path / f"doc{len(cuts)}.json"
        folder.mkdir()
        ends = [0, *cuts, len(text)]
        for i, (low, high) in enumerate(zip(ends, ends[1:])):
            (folder / f"part-{i}.txt").write_text(text[low:high], encoding="utf-8")
        assert read(spark, folder, 2) == dict(items(json.loads(text), 2))


def test_empty_arrays_and_nulls(spark, tmp_path):
    path = tmp_path / "doc.json"
    for text, level, want in (("[]", 1, {}), (" [ ] ", 2, {}), ("[[], [[]], null]", 2, {(1, 0): []}),
                              ("[null, 1]", 1, {(0,): None, (1,): 1}), ("[[1]]", 2, {(0, 0): 1})):
        path.write_text(text)
        assert read(spark, path, level) == want
    path.write_text('[[null, ["a", null]], null, []]')
    found = {tuple(r) for r in readers.read_answers(spark, str(path)).collect()}
    assert found == {(0, 0, None, None), (0, 1, 0, "a"), (0, 1, 1, None)}


@pytest.mark.parametrize("text", ["", "[", "[1]]", "[1],", "[1],[2]", "[1][2]", '["a]', "[1}", "[1",
                                  "1", "[[1],2]", "[,]", "[1,]", "[1,,2]", '{"a": 1}', "[1]x"])
def test_broken_arrays_fail(spark, tmp_path, text):
    path = tmp_path / "doc.json"
    path.write_text(text)
    with pytest.raises(Exception):
        rows = arrays.read_items(spark, str(path)).select(arrays.parsed(F.col("item"), "struct<a: int>"))
        rows.collect()
    with pytest.raises(Exception):
        readers.read_answers(spark, str(path)).collect()


def test_many_answers_in_many_tasks(spark, tmp_path):
    doc = [[[f"answer {t}, {q}, {a}" for a in range(20)] for q in range(200)] for t in range(5)]
    path = tmp_path / "answers.json"
    path.write_text(json.dumps(doc))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = readers.read_answers(spark, str(path)).collect()
        assert arrays._pieces(spark, str(path)).rdd.getNumPartitions() >= 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, rows)) == [(t, q, a, f"answer {t}, {q}, {a}") for t in range(5)
                                        for q in range(200) for a in range(20)]


def nested(rows):
    """Rows of task, query, place and answer as lists of lists."""
    out = []
    for i, (t, q, a, text) in enumerate(rows):
        if i == 0 or t != rows[i - 1][0]:
            out.append([])
        if i == 0 or (t, q) != rows[i - 1][:2]:
            out[-1].append([])
        if a is not None:
            out[-1][-1].append(text)
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_nested_export(spark, tmp_path, partitions):
    rows = [(t, q, a, f'text "{t}", [{q}]\n{a} ü\\') for t in (0, 2, 3) for q in range(7) for a in range(q % 4)]
    rows += [(1, 0, None, None), (3, 3, 50, None), (3, 9, None, None)]
    rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2]))
    df = spark.createDataFrame(rows, "task_idx int, query_idx int, answer_idx int, answer string")
    wanted = {"spark.sql.shuffle.partitions": str(partitions),
              "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in wanted}
    path = tmp_path / "out.json"
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        arrays.write_nested(df.repartition(3), str(path))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    parts = sorted(path.glob("part-*.txt"))
    assert len(parts) >= min(partitions, 2)
    doc = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
    assert doc == nested(rows)
    found = {tuple(r) for r in readers.read_answers(spark, str(path)).collect()}
    assert found == {(t, q, a, text) for t, task in enumerate(doc) for q, query in enumerate(task)
                     for a, text in (enumerate(query) if query else [(None, None)])}


def test_nested_export_of_nothing_and_of_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "task_idx int, query_idx int, answer_idx int, answer string")
    arrays.write_nested(none, str(tmp_path / "none.json"))
    assert readers.read_answers(spark, str(tmp_path / "none.json")).count() == 0
    vectors = spark.createDataFrame([(0, 0, 1, [1.5, 2.0]), (0, 0, 0, [0.25])],
                                    "task_idx int, query_idx int, answer_idx int, v array<float>")
    arrays.write_nested(vectors, str(tmp_path / "v.json"), value="v")
    assert read(spark, tmp_path / "v.json", 3) == {(0, 0, 0): [0.25], (0, 0, 1): [1.5, 2.0]}


def test_parts_are_in_the_order_of_their_numbers():
    names = ["p/part-100000-a", "p/part-99999-a", "p/part-00007-a"]
    assert sorted(names, key=arrays._in_order) == names[::-1]

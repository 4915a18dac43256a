"""The stages and the whole pipeline against loops on a small fixture."""

import random

import corpus_pipeline as c
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_decontamination import brute_force

from variegate.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, n_hit string"
ITEM = "which of these nine quiet rivers runs north before it reaches the old harbour town"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    words = {"en": "the and house river with from they would about some".split(),
             "de": "der und haus fluss mit von sie würde über einige".split()}

    def text(lang, n):
        return " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "en", "ly"]) for _ in range(n))

    passage = text("en", 120)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append((i, text(lang, 60 + i), lang))
    rows += [(100, rows[4][1], "en"), (101, rows[5][1].upper(), "en"), (102, None, "en"),
             (103, "12 34 !!", "de"), (104, "", None),
             (105, text("en", 40) + " " + passage, "en"), (106, passage + " " + text("en", 50), "en"),
             (107, text("en", 30) + " " + ITEM.title() + " " + text("en", 9), "en"),
             (None, text("de", 70), "de"), (7, rows[7][1], "en")]
    out = tmp_path_factory.mktemp("pipeline")
    full = [(i, t, lang, None, None if t is None else len(t), 3, "x") for i, t, lang in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string") \
        .write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows


def by_loops(rows):
    """What is left of the rows, by plain versions of the stages."""
    rows = [(i, t) for i, t, _ in rows if t and any(ch.isalpha() for ch in t)]
    prints = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.arange(len(rows))
    while not np.array_equal(label, new := np.array([label[near[i]].min() for i in range(len(rows))])):
        label = new
    groups = {}
    for k, row in zip(label, rows):
        groups.setdefault(k, set()).add(row)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    raws = [t.encode() for _, t in rows]
    counts = {}
    for raw in raws:
        for i in range(len(raw) - 399):
            counts[raw[i:i + 400]] = counts.get(raw[i:i + 400], 0) + 1
    out = []
    for (i, text), raw in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - 399):
            if counts[raw[j:j + 400]] > 1:
                gone[j:j + 400] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not brute_force([kept], {1: ITEM})[0][1]:
            out.append((i, kept))
    return out


def test_run(spark, folder):
    path, rows = folder
    found = c.run(spark, path).collect()
    expected = by_loops(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.text) for r in found], key=key) == sorted(expected, key=key)
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in found)
    assert {(r.kept, r.n_hit) for r in found} == {(3, "x")}  # columns that the stages do not know
    cut = {r.doc_id: r.n_chars for r in found if r.doc_id in (105, 106)}
    assert len(cut) == 2 and all(n < 600 for n in cut.values())
    ids = {r.doc_id for r in found}
    assert not ids & {100, 101, 102, 103, 104, 107} and {4, 5, 7, None} <= ids


def test_stages_return_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for number, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, folder[0])
        if number < len(c.STAGES) - 1:
            assert out.columns == docs.columns, name
        empty = stage(spark, docs.where(F.lit(False)), folder[0])
        assert empty.count() == 0, name


def test_stage_count():
    assert [n for n, _ in c.STAGES][:2] == ["language identification", "SimHash near-dedup"]
    assert len(c.STAGES) == 5 and c.ORACLE_SQL is None


def test_passages_of_over_50_words_are_cut(spark, folder):
    """Also those that take fewer than 400 bytes; 50 words stay."""
    rng = random.Random(2)
    own = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 5))) for _ in range(n))
    long, short = own(51), own(50)
    texts = [f"1: {long}\n{own(30)}", f"{own(9)}: {long}.", f"2: {short}\n{own(30)}", f"{own(9)}: {short}.", None]
    rows = [(i, t, "en", None, None if t is None else len(t), 3, "x") for i, t in enumerate(texts)]
    assert len(long) < 400
    found = {r.doc_id: r for r in c.cut_repeats(spark, spark.createDataFrame(rows, SCHEMA), folder[0]).collect()}
    assert [long.strip() in (found[i].text or "") for i in (0, 1)] == [False, False]
    assert [found[i].text for i in (2, 3, 4)] == texts[2:]
    assert found[0].text.startswith("1") and found[0].text.endswith(texts[0][-90:])
    assert all(found[i].n_chars == len(found[i].text) for i in range(4))

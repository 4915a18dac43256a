"""Contamination against a search word by word."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from variegate.llm import decontamination as d

ITEMS = {1: "One two three four five six seven eight nine ten eleven twelve.", 2: "Short item!",
         3: None, 4: "...", 5: "ONE two three four five six seven eight nine TEN", 6: "é ü",
         7: "a a a a a a a a a a a a", 8: "short item", None: "only null id"}
TEXTS = ["zero one two three four five six seven eight nine ten eleven twelve thirteen",
         "a short, ITEM short item", None, "", "?!", "É ü é ü", "shortitem short-item's",
         "a " * 30, "one two three four five six seven eight nine then", "Only NULL id",
         "x " * 5000 + "short item" + " y" * 5000]


def brute_force(docs: list[str | None], items: dict[int, str | None], n: int = d.WINDOW) -> list:
    """Word by word: ``(n_words, n_hit, n_items, digest)`` of each document."""
    def plain(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    out = []
    for text in docs:
        words, hit, names = plain(text), set(), set()
        for name, item in items.items():
            own = plain(item)
            size = min(n, len(own))
            for i in range(len(own) - size + 1 if own else 0):
                for j in range(len(words) - size + 1):
                    if words[j:j + size] == own[i:i + size]:
                        hit.update(range(j, j + size))
                        names.add(str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((len(words), len(hit), len(names), digest))
    return out


def rows_of(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_hit int")
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = d.mark_contamination(docs, table)
    return {r.doc_id: r for r in found.withColumn(
        "digest", d.items_digest(F.col("hit_items"))).collect()}


@pytest.mark.parametrize("most", [d.AUTOMATON_BYTES, 200])
def test_against_search(spark, monkeypatch, most):
    """One automaton, and so small a limit that there are several."""
    monkeypatch.setattr(d, "AUTOMATON_BYTES", most)
    found = rows_of(spark, TEXTS, ITEMS)
    named = {k: v for k, v in ITEMS.items() if k is not None}
    for i, expected in enumerate(brute_force(TEXTS, named)):
        if i != 9:
            row = found[i]
            assert (row.n_words, row.n_hit, len(row.hit_items), row.digest) == expected, TEXTS[i][:40]
    assert found[9].n_hit == 3 and found[9].hit_items == []  # an item without an id


def test_offsets(spark):
    text = "Ä  SHORT\titem, and one short item."
    row = rows_of(spark, [text], {2: "short item"})[0]
    assert [text[s.start:s.end] for s in row.hit_spans] == ["SHORT\titem", "short item"]


def test_random_words(spark):
    rng = random.Random(3)
    words = ["a", "b", "cc"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(30)]
    items = {i: " ".join(rng.choices(words, k=rng.randint(0, 14))) for i in range(12)}
    found = rows_of(spark, texts, items)
    for i, expected in enumerate(brute_force(texts, items)):
        row = found[i]
        assert (row.n_words, row.n_hit, len(row.hit_items), row.digest) == expected


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.mark_contamination(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b")] * 2, "doc_id long, text string")
    assert [(r.n_words, r.n_hit) for r in d.mark_contamination(one, items).collect()] == [(2, 0)] * 2

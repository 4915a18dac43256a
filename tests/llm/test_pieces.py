"""The trie, segmentations and sums of them, and round trips, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from variegate.llm import lattice, pieces, vocabulary as vocabularies
from variegate.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def vocabulary():
    return vocabularies.read_vocabulary(VOCABULARY)


def walk(trie, key):
    base, check, value = trie
    state = 0
    for byte in key:
        step = base[state] + byte + 1
        if check[step] != state:
            return -1
        state = step
    return value[state]


def test_double_array():
    rng = random.Random(1)
    keys = {bytes(rng.choices(range(256), k=rng.randint(1, 6))): i for i in range(3000)}
    keys |= {b"a" * k: 5000 + k for k in range(1, 20)}
    trie = vocabularies.double_array(keys)
    for key, value in keys.items():
        assert walk(trie, key) == value
    for _ in range(3000):
        other = bytes(rng.choices(range(256), k=rng.randint(1, 4)))
        assert walk(trie, other) == keys.get(other, -1)


@pytest.fixture(scope="module")
def small():
    """A vocabulary small enough for listing all segmentations."""
    rng = random.Random(2)
    names = [bytes([b]) for b in range(256)]
    keys = {}
    for key in {"".join(rng.choices("abc", k=rng.randint(1, 4))).encode() for _ in range(40)}:
        keys[key] = len(names)
        names.append(key)
    scores = np.full(len(names), -np.inf)
    scores[256:] = np.log(np.random.default_rng(3).random(len(names) - 256))
    base, check, value = vocabularies.double_array(keys)
    return {"base": base, "check": check, "value": value, "scores": scores, "names": names,
            "byte_ids": np.arange(256, dtype=np.int32), "fallback": -20.0, "longest": 4}


def segmentations(vocabulary, word):
    names = {n: i for i, n in enumerate(vocabulary["names"]) if i >= 256}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]
        choices = [([names[p]] if p in names else []) + ([p[0]] if len(p) == 1 else [])
                   for p in parts]
        yield from itertools.product(*choices)


def test_best_and_sums(small):
    rng = random.Random(4)
    words = list({"".join(rng.choices("abcd", k=rng.randint(1, 9))).encode() for _ in range(60)})
    chances = np.random.default_rng(5).random((len(small["names"]), 3)) / 50
    best, sums = lattice.best_pieces(small, words), lattice.log_sums(small, words, chances)
    counts = lattice.expected_counts(small, words, np.ones(len(words)), chances[:, 0].copy())
    expected = np.zeros(len(chances))
    for word, ids, own in zip(words, best, sums):
        ids = np.frombuffer(ids, np.int32)
        score = lambda x: sum(small["fallback"] if i < 256 else small["scores"][i] for i in x)
        every = list(segmentations(small, word))
        assert b"".join(small["names"][i] for i in ids) == word
        assert score(ids) == pytest.approx(max(map(score, every)))
        for lang in range(3):
            total = sum(math.prod(chances[i, lang] for i in x) for x in every)
            assert own[lang] == pytest.approx(math.log(total))
        total = sum(math.prod(chances[i, 0] for i in x) for x in every)
        for x in every:
            for i in x:
                expected[i] += math.prod(chances[j, 0] for j in x) / total
    np.testing.assert_allclose(counts, expected, atol=1e-9)


def test_long_words_as_short_ones(small, monkeypatch):
    words = [b"abcabdabcca" * 3, b"abc" * 20]
    chances = np.random.default_rng(6).random((len(small["names"]), 2)) / 50
    best, sums = lattice.best_pieces(small, words), lattice.log_sums(small, words, chances)
    weights, one = np.array([2.0, 0.5]), chances[:, 0].copy()
    counts = lattice.expected_counts(small, words, weights, one)
    monkeypatch.setattr(lattice, "LONG", 5)
    assert lattice.best_pieces(small, words) == best
    np.testing.assert_allclose(lattice.log_sums(small, words, chances), sums)
    np.testing.assert_allclose(lattice.expected_counts(small, words, weights, one), counts, atol=1e-12)


TEXTS = ["Hello world", "", None, " ", "  two  blanks ", "line\nbreaks\n\n and\ttabs\r", "▁ marker ▁▁x",
         "ÿ þ é ß ñ", "漢字 かな 🎉👩‍👩‍👧", "a" * 3000, "x y " * 60_000, "\x00\x01\x7f", "<0x41> <s>", "é​"]


def test_round_trip(spark, vocabulary):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS + TEXTS)],
                                 "doc_id long, text string, decoded int")
    rows = pieces.decode(pieces.encode(docs, vocabulary), vocabulary).collect()
    assert len(rows) == 2 * len(TEXTS)
    for row in rows:
        assert row.decoded == row.text, repr(row.text and row.text[:30])
        assert (row.piece_ids is None) == (row.text is None)
        if row.text == "":
            assert row.piece_ids == []
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0


def test_best_of_public_vocabulary(vocabulary):
    """The word-wise search gives as good a score as one over the whole text."""
    for text in ["The quick brown fox", "naïve café  ▁ 漢", "don't stop!!"]:
        words = pieces.split_words(text)
        ids = [i for b in lattice.best_pieces(vocabulary, words) for i in np.frombuffer(b, np.int32)]
        whole = lattice._best_of_long(vocabulary, b"".join(words))
        score = lambda x: sum(max(vocabulary["scores"][i], vocabulary["fallback"])
                              if np.isfinite(vocabulary["scores"][i]) else vocabulary["fallback"] for i in x)
        assert score(ids) == pytest.approx(score(whole))


def test_byte_pieces_and_bad_ids(spark, vocabulary):
    low, high = int(vocabulary["byte_ids"].min()), int(vocabulary["byte_ids"].max())
    docs = spark.createDataFrame([("\u0378",), (None,), ("the",)], "text string")
    counted = pieces.encode(docs, vocabulary).select(
        pieces.fallbacks(F.col("piece_ids"), low, high).alias("n")).collect()
    assert [r.n for r in counted] == [2, 0, 0]
    bad = spark.createDataFrame([([10**7],)], "piece_ids array<int>")
    with pytest.raises(Exception, match="IndexError|index"):
        pieces.decode(bad, vocabulary).collect()
    halves = spark.createDataFrame([([int(vocabulary["byte_ids"][0xC3])],)], "piece_ids array<int>")
    assert pieces.decode(halves, vocabulary).first().decoded == "�"

"""Repeated strings of 400 bytes against counting all of them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from variegate.llm import suffixes as s


def by_counting(texts):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i:i + 400] for r in raws for i in range(len(r) - 399))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 399):
            if counts[raw[i:i + 400]] > 1:
                gone[i:i + 400] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((len(raw), int(gone.sum()), int((edges == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


def some_texts():
    rng = random.Random(4)

    def word():
        return "".join(rng.choices("abcdeé", k=rng.randint(2, 9)))

    passage = " ".join(word() for _ in range(90))
    other = " ".join(word() for _ in range(200))
    texts = []
    for i in range(40):
        own = " ".join(word() for _ in range(rng.randint(5, 150)))
        texts.append(own + [" ", passage, passage[:401] + "!", passage[7:], other[3:900]][i % 5] + own[:30])
    texts += [None, "", "short", other, other, other, "z" * 900, "ab" * 300, "z" * 399, "z" * 400,
              passage[:400], (passage + "|" + passage), "é" * 450, own * 60]
    return texts


@pytest.mark.parametrize("large", [s.LARGE, 3])
def test_against_counting(spark, monkeypatch, large):
    """With a small limit most anchors take the way of hot ones."""
    monkeypatch.setattr(s, "LARGE", large)
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, b"x", 2) for i, t in enumerate(texts)],
                                 "doc_id long, text string, kept binary, k1 int").repartition(5)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha)
             for r in s.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()}
    for i, expected in enumerate(by_counting(texts)):
        assert found[i] == expected, i


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(s, "PART", 700)
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh ", k=6000))
    texts = [long + "x" + long[1000:2500], long[300:900], "q" + long[4000:4450]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in s.remove_repeats(docs).collect()}
    assert [found[i] for i in range(3)] == [x[1] for x in by_counting(texts)]


@pytest.mark.parametrize("seed", range(6))
def test_sort_kernel(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 97 + [2, 20, 1][seed % 3], 3000, dtype=np.uint8)
    text = np.concatenate([base, base[100:700], rng.integers(97, 110, 200, dtype=np.uint8),
                           base[1300:1300 + 400 + seed]])
    starts = np.flatnonzero(rng.random(len(text) - 399) < [1.0, 0.7][seed % 2])
    raw = text.tobytes()
    counts = Counter(raw[i:i + 400] for i in starts.tolist())
    assert s.repeated_starts(text, starts).tolist() == [counts[raw[i:i + 400]] > 1
                                                       for i in starts.tolist()]


def test_filter_misses_nothing(spark):
    names = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(n),) for n in names], "name long")
    for most in (1 << 25, 1 << 11):
        held = s.repeated_filter(df, len(names), most)
        bits = (len(held) * 8).bit_length() - 1
        for at in s._filter_bits(names, bits):
            assert (held[(at >> np.uint64(3)).astype(int)]
                    >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).all()


def test_removed_and_readable(spark):
    same = "é" * 200 + "x" * 100
    docs = spark.createDataFrame([(1, "ab" + same), (2, "cd" + same + "é")], "doc_id long, text string")
    rows = {r.doc_id: r for r in s.remove_repeats(docs).withColumn(
        "read", s.readable(F.col("kept"))).collect()}
    assert (rows[1].read, rows[2].read) == ("ab", "cdé")
    assert [(x.start, x.end) for x in rows[1].removed] == [(2, 502)]
    assert s.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length", [64, 101, 144, 200, 215, 217, 650])
def test_other_lengths(length):
    """Names of a third of the length and more are compared from end to end."""
    rng = np.random.default_rng(length)
    base = rng.integers(97, 97 + 2, 1500, dtype=np.uint8)
    text = np.concatenate([base, base[100:100 + 2 * length], rng.integers(97, 110, 90, dtype=np.uint8)])
    for at in range(1500 + length, 1500 + 2 * length, 7):  # one byte in the copy is another
        text[at] ^= rng.random() < 0.02
    text = np.concatenate([text, text[40:40 + length], text[700:699 + length], text[:9]])
    starts = np.arange(len(text) - length + 1)
    raw = text.tobytes()
    counts = Counter(raw[i:i + length] for i in starts.tolist())
    assert s.repeated_starts(text, starts, length).tolist() == [counts[raw[i:i + length]] > 1
                                                               for i in starts.tolist()]


@pytest.mark.parametrize("large", [s.LARGE, 3])
def test_passages_by_words(spark, monkeypatch, large):
    """Of the runs of repeated strings those of enough whole words go, or of 400 bytes."""
    monkeypatch.setattr(s, "LARGE", large)
    rng = random.Random(5)

    def own(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(n))

    long, short, glued, line = own(51), own(50), own(200).replace(" ", ""), "wide " * 30
    texts = [own(9) + "\n" + long + "\n" + own(20), long, own(3) + " " + short + " " + own(5),
             "x " + short + " " + own(4), "y" + short + " " + own(4), own(6) + glued + own(3), glued + " " + own(7),
             own(8) + "\n" + line + own(8), own(9) + "\n" + line + own(9), None, "", short, short]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.kept.decode() for r in s.remove_repeats(docs, length=101, least_words=51).collect()}
    for i, (text, cut) in enumerate(zip(texts, [long, long, "", "", "", glued, glued, *[""] * 6])):
        left = (text or "").replace(cut, "") if cut else text or ""
        # the byte beside a passage may be the same on both sides
        assert found[i] == left or cut and len(left.encode()) - len(found[i].encode()) in (1, 2), i
    with pytest.raises(ValueError, match="64 is the least"):
        s.remove_repeats(docs, length=63)

"""Quality classifier: Bradley-Terry scores of documents, learned from preference pairs.

A document of label 1 is preferred to one of label 0. With scores linear in a text's features the
model's chance of a preference is the logistic function of the difference of the scores, so fitting
it is a logistic regression without intercept on differences of features. The cut between classes is
a quantile of the scores of the training documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variegate.llm.common import checked_broadcast, without, written

SAMPLE = 6000  # labelled documents of each class that a model is fitted on
PAIRS = 8  # partners of each document
RIDGE = 1e-3
CUT_ACCURACY = 1_000_000  # of the quantile: an error of so small a part of the documents
CUT = 0.3  # the score at which a document counts as good
SHARE_PARTS = 1 << 30

FEATURES = ["log_words", "letters", "capitals", "digits", "blanks", "symbols", "hashes_and_signs",
            "exclamations", "bars", "stops", "commas", "word_length", "long_words", "lines",
            "line_repeats", "word_variety", "compression", "sentence_length", "empty", "capital_words",
            "urls", "high_bytes"]

LETTERS = bytes(range(ord("a"), ord("z") + 1)) + bytes(range(ord("A"), ord("Z") + 1))
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
WORD_START = re.compile(rb"[A-Z]{3,}")
URL = re.compile(rb"https?://|www\.")


@dataclass
class QualityModel:
    """Weights of the scaled features, and the raw score that maps to ``CUT``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float


def features(text: str | None) -> list[float]:
    """What a text looks like, from its bytes; all finite, and defined for null and empty ones."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, n_words = max(len(raw), 1), max(len(words), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / n
    small, large = share[97:123].sum(), share[65:91].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    stops = counts[46] + counts[33] + counts[63]
    packed = len(zlib.compress(raw, 1)) / n if raw else 1.0
    return [
        np.log1p(len(words)), small + large + share[128:].sum(), large / max(small + large, 1e-9),
        share[48:58].sum(), share[32], share[35:39].sum() + share[42] + share[64],
        (counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / n_words,
        counts[33] / n_words, counts[124] / n_words, counts[46] / n_words, counts[44] / n_words,
        sizes.mean(), (sizes > 15).mean(), np.log1p(len(lines)), 1 - len(set(lines)) / n_lines,
        len(set(words)) / n_words, min(packed, 2.0), np.log1p(len(words) / (stops + 1)),
        float(not words), len(WORD_START.findall(raw)) / n_words, len(URL.findall(raw)) / n_words,
        share[128:].sum()]


def with_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep).withColumn("features", F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch["__text"]]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in keep], pa.array(found, pa.list_(pa.float64()))],
                names=[*keep, "features"])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = SAMPLE) -> QualityModel:
    """Learn from labelled documents where ``usable``, at most about ``limit`` of each class.

    docs: doc_id, text. labels: doc_id, quality; a document with several labels takes the larger
    part of them, null ones do not count. Of a class with more documents those with the smallest
    hashes of id and text are taken, so the sample is the same in every run; copies of a row are in
    it once. The weights are fitted on the sample, the cut on all usable labelled documents, each as
    often as it is there. Without documents of both classes all scores are equal.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("__good"))
    known = written(known.where(usable))
    rows = docs.select("doc_id", "text").join(checked_broadcast(known), "doc_id") \
        .select("doc_id", "text", "__good", F.xxhash64("doc_id", "text").alias("__hash"))
    copies = written(rows.groupBy("doc_id", "__hash").agg(
        F.first("__good").alias("__good"), F.count(F.lit(1)).alias("__n")))
    counts = {r[0]: (r[1], r[2]) for r in copies.groupBy("__good").agg(
        F.count(F.lit(1)), F.sum("__n")).collect()}
    place = F.pmod(F.xxhash64("__hash", F.lit(11)), F.lit(SHARE_PARTS))
    share = {c: int(SHARE_PARTS * min(1.0, limit / n)) for c, (n, _) in counts.items()}
    chosen = copies.where(place < F.when(F.col("__good"), share.get(True, 0))
                          .otherwise(share.get(False, 0))).select("doc_id", "__hash")
    # the sample's size is set by `limit`, whatever the tables hold
    sample = with_features(rows.join(F.broadcast(chosen), ["doc_id", "__hash"])
                           .dropDuplicates(["doc_id", "__hash"]), ["doc_id", "__hash", "__good"]) \
        .select("doc_id", "__hash", "__good", "features").collect()
    sample = sorted(sample, key=lambda r: (r["doc_id"], r["__hash"]))
    values = np.array([r["features"] for r in sample]).reshape(len(sample), len(FEATURES))
    good = np.array([r["__good"] for r in sample], bool)
    model = bradley_terry(values, good)
    if not model.weights.any():
        return model
    raw = written(raw_scores(rows.select("text"), model))
    bad_share = counts[False][1] / (counts[False][1] + counts[True][1])
    below = raw.agg(F.percentile_approx("raw", bad_share, CUT_ACCURACY)).first()[0]
    above = raw.agg(F.min(F.when(F.col("raw") > below, F.col("raw")))).first()[0]
    model.cut = (below + (below if above is None else above)) / 2
    return model


def raw_scores(rows: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``raw``: scores of the texts before they are moved to the cut."""
    sent = rows.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, weights = sent.value
        for batch in batches:
            found = np.array([features(t.as_py()) for t in batch[text]], float)
            raw = expanded((found.reshape(len(batch), len(FEATURES)) - mean) / scale) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(raw)], names=["raw"])

    return rows.select(text).mapInArrow(run, "raw double")


def bradley_terry(values: np.ndarray, good: np.ndarray) -> QualityModel:
    """Weights that make preferred documents score higher; the cut is not yet known."""
    size = values.shape[1]
    if not good.any() or good.all():
        return QualityModel(np.zeros(size), np.ones(size), np.zeros(size), 0.0)
    mean, scale = values.mean(0), np.maximum(values.std(0), 1e-6)
    scaled = expanded((values - mean) / scale)
    rng = np.random.default_rng(1)
    more, less = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = PAIRS * max(len(more), len(less))
    differences = scaled[rng.choice(more, pairs)] - scaled[rng.choice(less, pairs)]
    weights = np.zeros(scaled.shape[1])
    for _ in range(30):  # Newton's method on the mean logistic loss
        chance = 1 / (1 + np.exp(-np.clip(differences @ weights, -30, 30)))
        slope = differences.T @ (chance - 1) / pairs + RIDGE * weights
        bend = (differences * (chance * (1 - chance))[:, None]).T @ differences / pairs
        step = np.linalg.solve(bend + RIDGE * np.eye(len(weights)), slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(mean, scale, weights, 0.0)


def expanded(scaled: np.ndarray) -> np.ndarray:
    """Features within bounds, and their squares."""
    held = np.clip(scaled, -6, 6)
    return np.concatenate([held, held ** 2], axis=1)


def score(model: QualityModel, values: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1: the chance to be preferred to a document at the cut, moved to ``CUT``."""
    if not model.weights.any():
        return np.full(len(values), 0.5)
    raw = expanded((values - model.mean) / model.scale) @ model.weights
    shift = np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(raw - model.cut + shift, -500, 500)))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``; null texts are scored as empty ones. Rows are kept.

    A column of ``docs`` with that name is replaced.
    """
    docs = without(docs, "quality_score")
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.mean, model.scale, model.weights, model.cut))
    schema = docs.withColumn("quality_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*sent.value)
        for batch in batches:
            found = np.array([features(t.as_py()) for t in batch[text]], float)
            scores = score(own, found.reshape(len(batch), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)],
                                             names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(run, schema)

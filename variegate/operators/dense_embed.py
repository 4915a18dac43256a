"""Dense vectors from the corpus itself: weighted counts of words, cut to their main directions.

The right singular vectors of the texts' weighted word counts are found by a randomised range finder.
Each round multiplies all rows with a thin matrix, takes the triangular factor of the tall result by a
tree of small QR factorisations, and the products back with the rows; from these follow the main
directions, with which the next round begins, until they stay. Spark holds the rows; the driver holds
matrices of features x directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variegate.functions.words import Tokenizer, whitespace_tokens
from variegate.session import cut_lineage

DIMENSIONS = 64
FEATURES = 1 << 14  # places that words are hashed to; the model has so many rows
OVERSAMPLE = 10
ROUNDS = 30
TOLERANCE = 1e-9  # of the main directions, from round to round
FAN = 32  # triangles or sums that one task of the tree joins


@dataclass
class DenseModel:
    """Weights of the features, and the main directions in columns, with their singular values."""

    weights: np.ndarray
    directions: np.ndarray
    values: np.ndarray


def features_of(text: Column, features: int = FEATURES, tokenizer: Tokenizer = whitespace_tokens) -> Column:
    """The hashed places of the words of a text, in lower case; null for null."""
    return F.transform(tokenizer(F.lower(text)), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def weigh(places: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of words to sparse rows of length 1: ``row, feature, value`` of each entry.

    A count c counts as 1 + ln(c), times the feature's weight.
    """
    n, width = len(starts) - 1, len(weights)
    row = np.repeat(np.arange(n), np.diff(starts))
    names, counts = np.unique(row.astype(np.int64) * width + places, return_counts=True)
    row, feature = names // width, names % width
    value = (1 + np.log(counts)) * weights[feature]
    lengths = np.sqrt(np.bincount(row, value ** 2, n))
    return row, feature, value / lengths[row]


def _entries(column: pa.Array, weights: np.ndarray) -> tuple[int, tuple[np.ndarray, ...]]:
    lists = column.drop_null()
    starts = lists.offsets.to_numpy()
    places = lists.flatten().to_numpy(zero_copy_only=False)
    return len(lists), weigh(places, starts - starts[0], weights)


def _times(n: int, entries: tuple, thin: np.ndarray) -> np.ndarray:
    """Sparse rows times a thin matrix."""
    row, feature, value = entries
    out = np.zeros((n, thin.shape[1]))
    cuts = np.flatnonzero(np.diff(row, prepend=-1))
    if len(cuts):
        out[row[cuts]] = np.add.reduceat(thin[feature] * value[:, None], cuts, axis=0)
    return out


def _passing(sent):
    """For the rows of a task: the triangle of their product, and the products back, by feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thin = sent.value
        width = thin.shape[1]
        triangle, back = np.zeros((0, width)), np.zeros(thin.shape)
        for batch in batches:
            for low in range(0, len(batch), 1000):
                n, entries = _entries(batch["features"].slice(low, 1000), weights)
                product = _times(n, entries, thin)
                triangle = np.linalg.qr(np.vstack([triangle, product]), mode="r")
                row, feature, value = entries
                order = np.argsort(feature, kind="stable")
                cuts = np.flatnonzero(np.diff(feature[order], prepend=-1))
                if len(cuts):
                    own = product[row[order]] * value[order, None]
                    back[feature[order][cuts]] += np.add.reduceat(own, cuts, axis=0)
        yield pa.RecordBatch.from_pylist([{"triangle": triangle.tobytes(), "back": back.tobytes()}])

    return run


PARTS = "triangle binary, back binary"


def _joining(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle, back = np.zeros((0, width)), None
        for batch in batches:
            for one, other in zip(batch["triangle"].to_pylist(), batch["back"].to_pylist()):
                triangle = np.linalg.qr(np.vstack([triangle, np.frombuffer(one).reshape(-1, width)]), mode="r")
                own = np.frombuffer(other)
                back = own.copy() if back is None else back + own
        if back is not None:
            yield pa.RecordBatch.from_pylist([{"triangle": triangle.tobytes(), "back": back.tobytes()}])

    return run


def range_pass(rows: DataFrame, weights: np.ndarray, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the matrix A of ``rows`` (column ``features``): the triangle of A x thin, and A' x A x thin.

    Tasks give one triangle and one sum each; a tree joins them, so no task and not the driver takes
    more than ``FAN`` of them.
    """
    sent = rows.sparkSession.sparkContext.broadcast((weights, thin))
    parts = rows.select("features").mapInArrow(_passing(sent), PARTS)
    count = rows.rdd.getNumPartitions()
    while count > FAN:
        count = -(-count // FAN)
        parts = cut_lineage(parts).repartition(count).mapInArrow(_joining(thin.shape[1]), PARTS)
    triangle, back = np.zeros((0, thin.shape[1])), np.zeros(thin.size)
    # made by all tasks at once; the iterator would run one task after the other
    for r in cut_lineage(parts).toLocalIterator():
        triangle = np.vstack([triangle, np.frombuffer(r["triangle"]).reshape(-1, thin.shape[1])])
        back = back + np.frombuffer(r["back"])
    sent.unpersist()
    return np.linalg.qr(triangle, mode="r"), back.reshape(thin.shape)


def main_directions(triangle: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors of A within the range that the pass has found.

    With A x thin = Q R the products back are A' Q R, so A' Q follows from R without Q. Directions
    that R does not hold, to rounding, are left out.
    """
    _, sizes, turned = np.linalg.svd(triangle)
    held = sizes > len(triangle) * np.finfo(float).eps * max(sizes.max(initial=0), np.finfo(float).tiny)
    small = back @ turned.T[:, :len(sizes)][:, held] / sizes[held]
    left, values, _ = np.linalg.svd(small, full_matrices=False)
    return values, left


def document_weights(rows: DataFrame, features: int) -> np.ndarray:
    """Weights 1 + ln((1 + texts) / (1 + texts with the feature))."""
    n = rows.where(F.col("features").isNotNull()).count()
    counts = np.zeros(features)
    seen = rows.select(F.explode(F.array_distinct("features")).alias("f")).groupBy("f").count()
    for r in seen.toLocalIterator():
        counts[r["f"]] = r["count"]
    return 1 + np.log((1 + n) / (1 + counts))


def fit_dense(df: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, features: int = FEATURES,
              tokenizer: Tokenizer = whitespace_tokens, rounds: int = ROUNDS,
              tolerance: float = TOLERANCE) -> DenseModel:
    """Learn directions from all texts of ``df``. Null texts are left out, texts without a word have
    no direction. There are fewer directions than asked for if the texts have no more.
    """
    rows = cut_lineage(df.select(features_of(F.col(text), features, tokenizer).alias("features"))
                       .where(F.col("features").isNotNull()))
    weights = document_weights(rows, features)
    width = min(dimensions + OVERSAMPLE, features)
    thin = np.random.default_rng(12).standard_normal((features, width))
    before, values, left = None, np.zeros(0), np.zeros((features, 0))
    for _ in range(rounds):
        triangle, back = range_pass(rows, weights, thin)
        values, left = main_directions(triangle, back)
        found = left[:, :dimensions]
        if not len(values):
            break
        if before is not None and before.shape == found.shape:
            moved = np.linalg.norm(found - before @ (before.T @ found), 2)
            if moved < tolerance:
                break
        before, thin = found, left
    held = values[:dimensions] > 1e-10 * values.max(initial=0)
    kept = left[:, :dimensions][:, held]
    signs = np.sign(kept[np.abs(kept).argmax(0), np.arange(kept.shape[1])]) if kept.size else 1.0
    return DenseModel(weights, kept * signs, values[:dimensions][held])


def dense_embedding(df: DataFrame, model: DenseModel, text: str = "text", column: str = "embedding",
                    tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """Add the place of each text along the model's directions; null for a null text, zeros for one
    without a word. The model is broadcast: features x directions, whatever the corpus."""
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.directions))
    kept = [c for c in df.columns if c != column]
    rows = df.select(*kept, features_of(F.col(text), len(model.weights), tokenizer).alias("__features"))
    schema = T.StructType([*df.select(*kept).schema.fields,
                           T.StructField(column, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, directions = sent.value
        for batch in batches:
            there = batch["__features"].is_valid().to_numpy(zero_copy_only=False)
            n, entries = _entries(batch["__features"], weights)
            found, product = [None] * len(batch), _times(n, entries, directions)
            for at, own in zip(np.flatnonzero(there), product):
                found[at] = own
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in kept], pa.array(found, pa.list_(pa.float64()))],
                names=[*kept, column])

    return rows.mapInArrow(run, schema)

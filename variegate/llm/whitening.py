"""Whitening of embeddings by spectral divide and conquer with QDWH polar decompositions.

The polar factor of a shifted covariance has the eigenvalues 1 and -1, so half of it and the unit
matrix is the projector on the eigenvectors above the shift. Its range and complement split the
matrix into two smaller ones, and so on until each component stands alone. Spark sums the moments;
the driver holds matrices of dimension x dimension only, and the components are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variegate.llm.common import written

COMPONENTS = 8
# Fixed values of the query: the grid on which entries are counted.
STEP, OFFSET = 1024.0, 100_000
HELD = float(1 << 61)  # entries beyond this on the grid stay at it
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """The fit of the vectors of one dimension: exact sums, components in columns, eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps.

    Steps with large weights go through a QR factorisation, the others through Cholesky's. From
    the least lower bound of a float, 1e-16, some six steps are enough.
    """
    size = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = 1e-16
    for _ in range(12):
        root = np.cbrt(4 * (1 - low * low) / low ** 4)
        one = np.sqrt(1 + root)
        wa = one + 0.5 * np.sqrt(max(8 - 4 * root + 8 * (2 - low * low) / (low * low * one), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))
            new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        else:
            lower = np.linalg.cholesky(np.eye(size) + wc * (x.T @ x))
            half = np.linalg.solve(lower, x.T)
            new = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(lower.T, half).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(low * (wa + wb * low * low) / (1 + wc * low * low), 1.0)
        if 1 - low < 4 * EPS and moved < np.cbrt(EPS):
            break
    return x


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces above and below a shift, or None if nothing parts them.

    The shift is the median of the diagonal, else the mean, which lies between the least and the
    largest eigenvalue, else places near it; the split of the least remaining coupling is taken.
    """
    size, middle = len(a), np.diag(a).mean()
    spread = np.linalg.norm(a - middle * np.eye(size)) / np.sqrt(size)
    best, least = None, np.inf
    for shift in (np.median(np.diag(a)), middle, *(middle + spread * s for s in
                                                  (0.1, -0.1, 0.3, -0.3, 0.6, -0.6, 0.9, -0.9))):
        projector = (polar(a - shift * np.eye(size)) + np.eye(size)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < size:
            continue
        start = np.random.default_rng(size).standard_normal((size, size))
        rest = np.eye(size) - projector
        for _ in range(2):
            start, _ = np.linalg.qr(np.hstack([projector @ start[:, :k], rest @ start[:, k:]]))
        above, below = start[:, :k], start[:, k:]
        coupling = np.linalg.norm(below.T @ a @ above)
        if coupling < least:
            best, least = (above, below), coupling
        if least <= 4 * size * EPS * scale:
            break
    return best


def leading(a: np.ndarray, top: int, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues, falling, and their unit eigenvectors in columns."""
    size = len(a)
    scale = np.linalg.norm(a) if scale is None else scale
    values = np.diag(a)
    if size == 1 or np.linalg.norm(a - np.diag(values)) <= EPS * scale:
        order = np.argsort(-values, kind="stable")[:top]
        return values[order], np.eye(size)[:, order]
    parts = split(a, scale)
    if parts is None:  # eigenvalues equal to rounding: every basis is one of eigenvectors
        order = np.argsort(-values, kind="stable")[:top]
        return values[order], np.eye(size)[:, order]
    found_values, found = [], []
    for basis in parts:
        lack = top - sum(map(len, found_values))
        if lack <= 0:
            break
        inner = basis.T @ a @ basis
        own_values, own = leading((inner + inner.T) / 2, lack, scale)
        found_values.append(own_values)
        found.append(basis @ own)
    return np.concatenate(found_values), np.hstack(found)


def components_of(covariance: np.ndarray, top: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors with a variance above rounding, at most ``top``."""
    if not covariance.size or not np.any(covariance):
        return np.zeros(0), np.zeros((len(covariance), 0))
    _, vectors = leading(covariance, top)
    vectors, r = np.linalg.qr(vectors)
    vectors = vectors * np.sign(np.diag(r))
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    kept = values > len(covariance) * EPS * values[0]
    return values[kept], vectors[:, kept]


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows whose vector is there and has finite entries only."""
    whole = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                     & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(embedding).isNotNull() & whole) \
        .select("vec_id", F.col(embedding).cast("array<double>").alias("vector"))


def _by_size(batch: pa.RecordBatch, column: str = "vector") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length in a batch: their places and the vectors as a matrix."""
    lists = batch[column]
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def on_grid(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(STEP * values), -HELD, HELD).astype(np.int64) + OFFSET


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for rows, values in _by_size(batch):
            x, size = on_grid(values), values.shape[1]
            safe = not x.size or int(np.abs(x).max()) * len(rows) < 1 << 62
            own = x.sum(0) if safe else x.astype(object).sum(0)
            counts[size] = counts.get(size, 0) + len(rows)
            sums[size] = sums.get(size, np.zeros(size, object)) + own.astype(object)
    for size, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * size, pa.int32()), pa.array(np.arange(size), pa.int32()),
             pa.array([counts[size]] * size, pa.int64()),
             pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))],
            names=["size", "i", "n", "total"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n``: whole numbers first, then the fraction, so nothing is lost."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - part


def _products(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, values in _by_size(batch):
                size = values.shape[1]
                if size:
                    z = _centred(on_grid(values), *sent.value[size])
                    found[size] = found.get(size, 0.0) + z.T @ z
        for size, total in found.items():
            yield _matrix_rows(size, total)

    return run


def _matrix_rows(size: int, matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([size] * len(matrix), pa.int32()), pa.array(np.arange(len(matrix)), pa.int32()),
         pa.array(list(matrix), pa.list_(pa.float64()))], names=["size", "i", "row"])


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Matrices by size from rows of partial sums; added up in Spark entry by entry."""
    entries = rows.select("size", "i", F.posexplode("row").alias("j", "value")) \
        .groupBy("size", "i", "j").agg(F.sum("value").alias("value")) \
        .groupBy("size", "i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("row"))
    found: dict[int, dict] = {}
    for r in entries.collect():
        found.setdefault(r["size"], {})[r["i"]] = [e["value"] for e in r["row"]]
    return {size: np.array([own[i] for i in sorted(own)]) for size, own in found.items()}


def fit(rows: DataFrame, top: int = COMPONENTS) -> dict[int, Whitening]:
    """Fits by dimension for ``rows(vec_id, vector)``, a written table of usable vectors.

    Vectors of another dimension have a fit of their own. What reaches the driver is a row of sums
    and a matrix for each dimension that occurs, whatever the number of vectors.
    """
    spark = rows.sparkSession
    totals = rows.select("vector").mapInArrow(_fitting, "size int, i int, n long, total decimal(38,0)") \
        .groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    sums: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(totals, key=lambda r: (r["size"], r["i"])):
        sums.setdefault(r["size"], (r["n"], []))[1].append(int(r["total"]))
    sent = spark.sparkContext.broadcast(sums)
    matrices = _summed(rows.select("vector").mapInArrow(_products(sent), "size int, i int, row array<double>"))
    sent.unpersist()
    out = {}
    for size, (n, own) in sums.items():
        covariance = matrices[size] / n
        covariance = (covariance + covariance.T) / 2
        values, vectors = components_of(covariance, top)
        out[size] = Whitening(n, own, vectors, values, float(np.trace(covariance)))
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum((n * x - sums) ** 2)`` in whole numbers; null where that is no long."""
    whole = np.array([s // n for s in sums], np.int64)
    off = x - whole
    most = (int(np.abs(off).max(initial=0)) + 1) * n
    if most * most * x.shape[1] < 1 << 63:
        y = off * n - np.array([s % n for s in sums], np.int64)
        return (y * y).sum(1).tolist()
    y = off.astype(object) * n - np.array([s % n for s in sums], object)
    return [v if v < 1 << 63 else None for v in (y * y).sum(1).tolist()]


def _whitening(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in _by_size(batch):
                size = values.shape[1]
                if not size:
                    continue
                n, sums, vectors, variances = sent.value[size]
                x = on_grid(values)
                found = _centred(x, n, sums) @ vectors / np.sqrt(variances)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"].take(pa.array(rows)), pa.array([size] * len(rows), pa.int32()),
                     pa.array(_deviations(x, n, sums), pa.int64()),
                     pa.array(list(found), pa.list_(pa.float64()))],
                    names=["vec_id", "size", "deviation", "white"])

    return run


def whiten(rows: DataFrame, fits: dict[int, Whitening]) -> DataFrame:
    """``vec_id, size, deviation, white``: whitened vectors, shorter where components lack."""
    sent = rows.sparkSession.sparkContext.broadcast(
        {s: (f.n, f.sums, f.components, f.values) for s, f in fits.items()})
    return rows.mapInArrow(_whitening(sent), rows.select("vec_id").withColumns(
        {"size": F.lit(0), "deviation": F.lit(None).cast("long"),
         "white": F.lit(None).cast("array<double>")}).schema)


def identity_error(white: DataFrame, fits: dict[int, Whitening]) -> float:
    """The largest absolute entry of the covariances of whitened vectors less the unit matrix.

    Means are taken first, then products of what is left. Without components it is 0.
    """
    spark = white.sparkSession
    means = white.select("size", F.posexplode("white").alias("j", "value")) \
        .groupBy("size", "j").agg(F.avg("value").alias("mean")).collect()
    centre = {s: np.zeros(len(f.values)) for s, f in fits.items()}
    for r in means:
        centre[r["size"]][r["j"]] = r["mean"]
    sent = spark.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for rows, values in _by_size(batch, "white"):
                for size in np.unique(sizes[rows]).tolist():
                    z = values[sizes[rows] == size] - sent.value[size]
                    if z.shape[1]:
                        found[size] = found.get(size, 0.0) + z.T @ z
        for size, total in found.items():
            yield _matrix_rows(size, total)

    sums = _summed(white.select("size", "white").mapInArrow(run, "size int, i int, row array<double>"))
    return max([float(np.abs(m / fits[s].n - np.eye(len(m))).max()) for s, m in sums.items()], default=0.0)


def whitened_components(vectors: DataFrame, top: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of usable vectors.

    vectors: vec_id, embedding; other columns are not looked at. Vectors that are null or hold null
    or non-finite entries are left out, and so are empty ones, which have no component. Repeated
    rows and null ids are rows like others. Vectors of another dimension are whitened among
    themselves. Components without variance (beyond rounding) cannot be whitened and have no rows:
    so one vector, or copies of one, give none. An entry whose place on the grid is over 2^61 stays
    there, and a deviation that is no long is null. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors))
    fits = fit(rows, top)
    white = written(whiten(rows, fits))
    error = identity_error(white, fits)
    parts = [(s, k + 1, f.n, float(v / f.trace)) for s, f in fits.items() for k, v in enumerate(f.values)]
    about = spark.createDataFrame(parts, "__size int, __component int, n long, explained double")
    return white.select("vec_id", "size", "deviation", F.posexplode("white").alias("__k", "whitened")) \
        .join(F.broadcast(about), (F.col("size") == F.col("__size"))
              & (F.col("__k") + 1 == F.col("__component"))) \
        .select("vec_id", F.col("__component").alias("component"), "n", "deviation", "whitened",
                "explained", F.lit(error).alias("identity_error"))

"""Nearest neighbours by cosine: multiprobe p-stable hashing with exact reranking.

A table rounds a few random projections of the unit vector, shifted, to cells; for the normal
distribution, which is 2-stable, near vectors tend to share cells. A query visits its own bucket of
each table and then perturbed ones, in the order of the squared distance from the query to the
cell borders that the perturbation crosses, which is the order of estimated success. Candidates of
all tables are merged and ranked by their cosine on the original vectors, in doubles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variegate.llm.common import checked_broadcast, written

TABLES = 4
WIDTH = 1.44  # of a cell; a projection of a unit vector has standard deviation 1
FIRST_ROWS = 100_000  # for which four projections are enough; three times as many need one more
MOST_MOVES = 3_000  # perturbations that a query chooses from, those of fewest crossed borders
SAMPLE = 4000  # vectors that the number of probes is fitted on
SAMPLE_QUERIES = 300
RECALL = 0.985  # of the sample's neighbours, that the fitted number of probes finds
BLOCK = 4096  # vectors of a bucket that a task compares at once
HELD = 20_000  # queries whose best are held in a task before they are passed on
EXACT_AT_ONCE = 1000


def usable(vector: Column) -> Column:
    """Not null nor zero, without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & ~odd & some, F.lit(False))


class Tables:
    """Projections, shifts and the perturbations of all tables; the same for the same sizes."""

    def __init__(self, size: int, projections: int, tables: int = TABLES, width: float = WIDTH):
        rng = np.random.default_rng(5)
        self.axes = rng.normal(size=(tables, size, projections)) / width
        self.shifts = rng.uniform(0, 1, (tables, 1, projections))
        self.moves = moves_of(projections, MOST_MOVES)

    def cells(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells as whole numbers and the place within them: tables x vectors x projections."""
        at = np.einsum("nd,tdk->tnk", units, self.axes) + self.shifts
        cells = np.floor(at)
        return cells.astype(np.int64), at - cells

    def probes(self, units: np.ndarray, count: int) -> np.ndarray:
        """Cells to visit, best first: tables x vectors x count x projections."""
        cells, within = self.cells(units)
        below, above = within ** 2, (1 - within) ** 2
        cost = below @ (self.moves == -1).T + above @ (self.moves == 1).T
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :count]
        return cells[:, :, None, :] + self.moves[best]


def moves_of(projections: int, most: int) -> np.ndarray:
    """Perturbations that cross a border in the fewest projections, all up to some number of them."""
    rows = [np.zeros((1, projections), np.int8)]
    total = 1
    for crossed in range(1, projections + 1):
        total += math.comb(projections, crossed) * 2 ** crossed
        if total > most:
            break
        for where in itertools.combinations(range(projections), crossed):
            own = np.zeros((2 ** crossed, projections), np.int8)
            own[:, where] = list(itertools.product((-1, 1), repeat=crossed))
            rows.append(own)
    return np.concatenate(rows)


def bucket_names(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of the last axis: 64 bits, mixed."""
    name = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        name = (name ^ cells[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so nothing overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def projections_for(rows: int) -> int:
    """Four for few rows, one more for every threefold, so buckets do not grow with the table."""
    return int(4 + max(0, np.ceil(np.log(max(rows, 1) / FIRST_ROWS) / np.log(3))))


def fitted(size: int, rows: int, sample: np.ndarray, k: int) -> tuple[Tables, int]:
    """Tables, and the probes of each; with fewer projections where no probes meet the goal."""
    for projections in range(projections_for(rows), 4, -1):
        tables = Tables(size, projections)
        probes = fitted_probes(tables, sample, k)
        if probes is not None:
            return tables, probes
    tables = Tables(size, 4)
    return tables, fitted_probes(tables, sample, k) or len(tables.moves)


def fitted_probes(tables: Tables, sample: np.ndarray, k: int, goal: float = RECALL) -> int | None:
    """Probes of each table with which ``goal`` of the sample's nearest vectors are met; None if all
    perturbations are too few."""
    most = len(tables.moves)
    if len(sample) < 2:
        return most
    units = unit(sample)
    asked = units[:SAMPLE_QUERIES]
    scores = asked @ units.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -2
    near = np.argsort(-scores, axis=1)[:, :min(k, len(units) - 1)]
    names = bucket_names(tables.cells(units)[0])
    visited = bucket_names(tables.probes(asked, most))
    rank = np.full(near.shape, most)
    for t in range(len(names)):
        met = visited[t][:, None, :] == names[t][near][:, :, None]
        rank = np.minimum(rank, np.where(met.any(2), met.argmax(2), most))
    needed = int(np.sort(rank.ravel())[int(np.ceil(goal * rank.size)) - 1]) + 1
    return needed if needed <= most else None


class Best:
    """The best ``k`` rows of each query so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, queries: list, asked: np.ndarray, stored: np.ndarray, ids: list) -> None:
        """ids: the rows of each stored vector, ascending."""
        rough = asked @ stored.T
        k = min(self.k, rough.shape[1])
        # All that may tie with the k-th stay in. A product of matrices rounds as its shape has it,
        # so what counts is summed anew, pair by pair.
        least = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
        where, which = np.nonzero(rough >= least[:, None] - 1e-12)
        scores = (asked[where] * stored[which]).sum(axis=1).tolist()
        cuts = np.searchsorted(where, np.arange(len(queries) + 1)).tolist()
        which = which.tolist()
        for name, low, high in zip(queries, cuts[:-1], cuts[1:]):
            new = [(-s, r) for s, v in zip(scores[low:high], which[low:high]) for r in ids[v]]
            self.rows[name] = sorted({*self.rows.get(name, ()), *new})[:self.k]

    def batch(self) -> pa.RecordBatch:
        rows = [(*name, r, -s) for name, found in self.rows.items() for s, r in found]
        self.rows = {}
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=["q1", "q2", "row", "score"])


FOUND = "q1 long, q2 long, row long, score double"


def nearest(vectors: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found of each query.

    vectors: vec_id, embedding; asks: which rows are queries. All rows but the query's own are
    candidates, copies too. Null, zero, null-holding and non-finite vectors take no part, nor do null
    ids. Vectors of different dimensions have no cosine, so each dimension is searched by itself.
    A query without another row of its dimension has no result. A query that meets fewer than ``k``
    rows in its buckets is compared with all. Equal vectors are one entry with their ``k + 1``
    smallest different ids, all that can appear in a result: an id counts once for a vector,
    however often the row is repeated. An id with several vectors is a candidate with each of them,
    and its queries exclude all rows of that id.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding") \
        .where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    keyed = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"),
                        F.xxhash64(F.lit(1), "embedding").alias("k2"))
    sizes = sorted(r[0] for r in keyed.select(F.size("embedding")).distinct().collect())
    schema = T.StructType([T.StructField("query_id", T.LongType()),
                           T.StructField("rank", T.IntegerType()),
                           T.StructField("vec_id", T.LongType()),
                           T.StructField("score", T.DoubleType())])
    out = None
    for size in sizes:
        own = _nearest_of(keyed.where(F.size("embedding") == size), asks, size, k)
        out = own if out is None else out.union(own)
    return spark.createDataFrame([], schema) if out is None else out


def _nearest_of(keyed: DataFrame, asks: Column, size: int, k: int) -> DataFrame:
    """:func:`nearest` among vectors of one dimension: vec_id, embedding, k1, k2."""
    from pyspark.sql import Window
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    different = keyed.groupBy("k1", "k2", "vec_id").agg(F.first("embedding").alias("embedding"))
    few = different.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= k + 1)
    entries = written(few.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"),
        F.first("embedding").alias("embedding")))
    asked = keyed.where(asks).select(F.col("vec_id").alias("query_id"), "k1", "k2")
    wanted = written(keyed.where(asks).groupBy("k1", "k2")
                     .agg(F.first("embedding").alias("embedding")))
    total = entries.count()
    share = int((1 << 30) * min(1.0, SAMPLE / max(total, 1)))
    sample = entries.where(F.pmod("k2", F.lit(1 << 30)) < share).orderBy("k1", "k2") \
        .limit(2 * SAMPLE).select("embedding").collect()
    tables, probes = fitted(size, total, np.array([r[0] for r in sample], float).reshape(-1, size), k)
    found = _found(entries, wanted, tables, probes, size, k)
    best = _merged(found, k)
    lacking = written(wanted.join(best.where(F.size("best") > k), ["k1", "k2"], "left_anti"))
    missing = _compared_with_all(lacking, entries, size, k)
    if missing is not None:
        best = written(_merged(missing.unionByName(found), k))
    own = F.slice(F.filter("best", lambda x: x["row"] != F.col("query_id")), 1, k)
    ranked = asked.join(best, ["k1", "k2"]).select("query_id", F.posexplode(own).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"),
                         F.col("x.row").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k + 1`` rows of each query; what a query has met is bounded by its probes."""
    rows = F.collect_set(F.struct((-F.col("score")).alias("minus"), "row"))
    return found.groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")) \
        .agg(F.slice(F.sort_array(rows), 1, k + 1).alias("best"))


def _found(entries: DataFrame, wanted: DataFrame, tables: Tables, probes: int, size: int,
           k: int) -> DataFrame:
    sent = entries.sparkSession.sparkContext.broadcast(
        {"axes": tables.axes, "shifts": tables.shifts, "moves": tables.moves})

    def placed(count):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Tables.__new__(Tables)
            own.__dict__.update(sent.value)
            for batch in batches:
                for low in range(0, len(batch), 1024):
                    part = batch.slice(low, 1024)
                    units = unit(matrix(part["embedding"], size))
                    cells = own.probes(units, count)
                    names = bucket_names(cells)
                    for t in range(len(names)):
                        n = names.shape[2]
                        at = pa.array(np.repeat(np.arange(len(part)), n))
                        copied = pa.RecordBatch.from_arrays(part.columns, part.schema.names).take(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), t, np.int32)), pa.array(names[t].ravel()),
                             *copied.columns], names=["table", "bucket", *part.schema.names])
        return run

    head = "table int, bucket long, k1 long, k2 long, "
    index = entries.select("k1", "k2", "ids", "embedding").mapInArrow(
        placed(1), head + "ids array<long>, embedding array<float>"
        if _is_float(entries) else head + "ids array<long>, embedding array<double>")
    visits = wanted.select("k1", "k2", "embedding").mapInArrow(
        placed(probes), head + ("embedding array<float>" if _is_float(entries)
                                else "embedding array<double>"))
    counts = written(index.groupBy("table", "bucket").count()
                     .withColumn("blocks", F.ceil(F.col("count") / BLOCK)).drop("count"))
    side = checked_broadcast(counts)
    stored = index.join(side, ["table", "bucket"]).select(
        "table", "bucket", F.pmod("k1", "blocks").alias("block"), F.lit(0).alias("kind"), "k1", "k2",
        "ids", "embedding")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    visiting = visits.join(side, ["table", "bucket"]).select(
        "table", "bucket", every.alias("block"), F.lit(1).alias("kind"), "k1", "k2",
        F.lit(None).cast("array<long>").alias("ids"), "embedding")
    together = stored.unionByName(visiting).repartition("table", "bucket", "block") \
        .sortWithinPartitions("table", "bucket", "block", "kind")
    return together.mapInArrow(_compare(size, k + 1), FOUND)


def _is_float(entries: DataFrame) -> bool:
    return isinstance(entries.schema["embedding"].dataType.elementType, T.FloatType)


def _compare(size: int, k: int):
    """Rows of a block come first, its visitors after them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, current, held, ids, stored = Best(k), None, [], [], None
        for batch in batches:
            names = np.stack([batch[c].to_numpy().astype(np.int64)
                              for c in ("table", "bucket", "block", "kind")], axis=1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), len(names)]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                name, kind = tuple(names[low, :3]), names[low, 3]
                part = batch.slice(low, high - low)
                if name != current:
                    current, held, ids, stored = name, [], [], None
                units = unit(matrix(part["embedding"], size))
                if kind == 0:
                    held.append(units)
                    ids += part["ids"].to_pylist()
                    continue
                if not held:
                    continue
                if stored is None:
                    stored = np.concatenate(held)
                asks = list(zip(part["k1"].to_pylist(), part["k2"].to_pylist()))
                for at in range(0, len(asks), 512):
                    best.add(asks[at:at + 512], units[at:at + 512], stored, ids)
                if len(best.rows) > HELD:
                    yield best.batch()
        yield best.batch()

    return run


def _compared_with_all(lacking: DataFrame, entries: DataFrame, size: int, k: int):
    """Exactly, for the queries whose buckets held too few rows; some thousand at once."""
    total = lacking.count()
    if not total:
        return None
    parts, out = -(-total // EXACT_AT_ONCE), None
    for part in range(parts):
        rows = lacking.where(F.pmod("k1", F.lit(parts)) == part).collect()
        if not rows:
            continue
        sent = entries.sparkSession.sparkContext.broadcast(
            ([(r["k1"], r["k2"]) for r in rows], unit(np.array([r["embedding"] for r in rows], float))))
        found = entries.mapInArrow(_compare_all(sent, size, k + 1), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def _compare_all(sent, size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        names, asked = sent.value
        for batch in batches:
            for low in range(0, len(batch), BLOCK):
                part = batch.slice(low, BLOCK)
                units = unit(matrix(part["embedding"], size))
                best.add(names, asked, units, part["ids"].to_pylist())
        yield best.batch()

    return run

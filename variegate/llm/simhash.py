"""SimHash near-dedup: pivot distance tables discard pairs of fingerprints, popcounts verify.

Fingerprints within three bits agree in one of four blocks of 16 bits, and there in one of four
parts of the remaining 48. So pairs are only looked for among fingerprints that agree in one of
16 sets of 28 bits. A set of bits shared by very many of them is cut further by the same rule,
until at most 2**11 different fingerprints can share it. Within it, a table of distances to 16
reference fingerprints discards every pair that differs by more than three in any coordinate
(the triangle inequality), and what is left is verified by counting bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variegate.llm.common import checked_broadcast, lean_batches, tidy, written
from variegate.llm.components import connected

SHINGLE = 3
SEED = 42
DISTANCE = 3
ALL_BITS = (1 << 64) - 1
PIVOTS = [int(x) for x in np.random.default_rng(64).integers(0, 1 << 64, 16, dtype=np.uint64)]
LARGE = 4096  # different fingerprints that share bits and are compared in one task
PAIRS_AT_ONCE = 1 << 20


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64 bits: each set if it is set in over half of the shingles' hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(n, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), len(ends)
    for low in range(0, total, 1 << 16):  # bounds the memory for a very long text
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in
                              zip(starts[low:low + (1 << 16)], ends[low:low + (1 << 16)])),
                             np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``__fp``, the fingerprint as a signed long; null and wordless texts have 0."""
    lean_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep).withColumn("__fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch["__text"]), np.uint64,
                                len(batch)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(found)],
                                             names=[*keep, "__fp"])

    return rows.mapInArrow(tidy(run), schema)


def refine(mask: int) -> list[int]:
    """``mask`` with one of four parts of the bits it leaves: one must agree too.

    A pair that differs in at most three bits, none of them in ``mask``, agrees in at least one
    of the four parts.
    """
    free = [i for i in range(64) if not mask >> i & 1]
    parts = np.array_split(free, DISTANCE + 1)
    return [mask | sum(1 << int(i) for i in part) for part in parts]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def linked_pairs(prints: DataFrame, large: int = LARGE) -> DataFrame:
    """Links ``a, b`` that join all fingerprints (column ``__fp``, all different) within 3 bits.

    Of the links among fingerprints that share bits a spanning forest is returned, so that their
    number grows as the fingerprints do, not as their pairs; the components are those of all
    links.
    """
    coordinates = F.concat(*[
        F.unhex(F.lpad(F.hex(F.bit_count(F.col("__fp").bitwiseXOR(F.lit(_signed(p))))), 2, "0"))
        for p in PIVOTS])
    pivoted = written(prints.select("__fp", coordinates.alias("__at")))
    masks = [m for first in refine(0) for m in refine(first)]
    rows = pivoted.withColumn("__mask", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])))
    spark, out = prints.sparkSession, None
    while True:
        keyed = rows.withColumn("__key", F.col("__fp").bitwiseAND(F.col("__mask")))
        sizes = written(keyed.groupBy("__mask", "__key").agg(F.count(F.lit(1)).alias("__n"))
                        .where(F.col("__n") > 1))
        # of the shared keys there are few, as fingerprints of unlike texts seldom agree so far
        shared = keyed.join(checked_broadcast(sizes), ["__mask", "__key"])
        small = shared.where(F.col("__n") <= large).repartition("__mask", "__key") \
            .sortWithinPartitions("__mask", "__key").select("__mask", "__key", "__fp", "__at")
        links = small.mapInArrow(tidy(_link_runs), "a long, b long")
        out = links if out is None else out.union(links)
        hot = [r[0] for r in sizes.where(F.col("__n") > large).select("__mask").distinct().collect()]
        if not hot:  # masks are a fixed set, four times as many in each round
            return out
        finer = spark.createDataFrame([(m, _signed(x)) for m in hot for x in refine(m & ALL_BITS)],
                                      "__mask long, __finer long")
        rows = shared.where(F.col("__n") > large).join(F.broadcast(finer), "__mask") \
            .select("__fp", "__at", F.col("__finer").alias("__mask"))


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, name = [], None
    for batch in batches:
        masks, keys = (batch[c].to_numpy() for c in ("__mask", "__key"))
        cuts = np.flatnonzero((masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for low, high in zip(edges[:-1], edges[1:]):
            if low == high:
                continue
            own = (masks[low], keys[low])
            if held and own != name:
                yield from _linked(held)
                held = []
            name = own
            held.append(batch.slice(low, high - low))
    if held:
        yield from _linked(held)


def _linked(run: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prints = np.concatenate([b["__fp"].to_numpy() for b in run])
    at = np.frombuffer(b"".join(x.as_py() for b in run for x in b["__at"]), np.uint8) \
        .reshape(len(prints), -1).astype(np.int16)
    roots = spanning_roots(prints.view(np.uint64), at)
    other = roots != np.arange(len(roots))
    if other.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array(prints[roots[other]]), pa.array(prints[other])], names=["a", "b"])


def spanning_roots(prints: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each fingerprint the first one of those it is linked with, directly or not.

    Sorted by the first coordinate, a fingerprint is held against those at most three further;
    the other coordinates discard, one after the other; the bits decide.
    """
    order = np.argsort(at[:, 0], kind="stable")
    first = at[order, 0]
    ends = np.searchsorted(first, first + DISTANCE, side="right")
    counts = ends - np.arange(len(order)) - 1
    roots = np.arange(len(order))
    low = 0
    while low < len(order):
        high = max(low + 1, int(np.searchsorted(np.cumsum(counts[low:]), PAIRS_AT_ONCE)) + low)
        n = counts[low:high]
        left = np.repeat(np.arange(low, low + len(n)), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        left, right = order[left], order[right]
        differ = roots[left] != roots[right]
        left, right = left[differ], right[differ]
        for pivot in range(1, at.shape[1]):
            near = np.abs(at[left, pivot] - at[right, pivot]) <= DISTANCE
            left, right = left[near], right[near]
        near = np.bitwise_count(prints[left] ^ prints[right]) <= DISTANCE
        roots = _merged(roots, left[near], right[near])
        low = high
    return roots


def _merged(roots: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    while True:
        a, b = roots[left], roots[right]
        differ = a != b
        if not differ.any():
            return roots
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(roots, roots[roots]):
            roots = roots[roots]


def _with_components(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``doc_id, __hash`` (of the text), ``__fp`` and ``__least``, the first row of the component.

    The first row is the one of the smallest id, nulls last, and among these of the smallest hash.
    """
    keys = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("__hash"),
                       F.col(text).alias("text"))
    found = written(with_fingerprints(keys, ["doc_id", "__hash"]))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__hash")
    prints = written(found.groupBy("__fp").agg(F.min(place).alias("__own")))
    links = written(linked_pairs(prints.select("__fp")))
    roots = connected(links).withColumnRenamed("node", "__fp")
    rooted = prints.join(roots, "__fp", "left").withColumn("root", F.coalesce("root", "__fp"))
    # a component may hold most of the fingerprints; of components of several there are few
    least = written(rooted.groupBy("root").agg(F.min("__own").alias("__least"), F.count(F.lit(1)).alias("__n"))
                    .where(F.col("__n") > 1).drop("__n"))
    named = rooted.join(checked_broadcast(least), "root", "left") \
        .select(F.col("__fp").alias("__of"), F.coalesce("__least", "__own").alias("__least"))
    return found.join(named, F.col("__fp") == F.col("__of")).drop("__of")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    component_id is the smallest doc_id that links of at most three bits reach, the own one
    included. Equal fingerprints are always linked; those of null, empty and wordless texts are
    zero and linked like any other. Null ids take the smallest other id of their component, or
    null. Rows are kept as they are. Fingerprints are made unique before pairs are looked for, so
    copies cost nothing; other columns of ``docs`` are not read.
    """
    printed = F.lower(F.lpad(F.hex("__fp"), 16, "0"))
    return _with_components(docs, text, doc_id).select(
        "doc_id", printed.alias("fingerprint"), F.col("__least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: that of the smallest id.

    Of several rows with this id the one with the smallest hash of its text stays; of rows that
    are equal in both, one. Null ids come last. The texts are only shuffled if the list of what
    goes is not counted to be short.
    """
    placed = written(_with_components(docs, text, doc_id))
    stays = F.col("doc_id").eqNullSafe(F.col("__least.doc_id")) \
        & F.col("__hash").eqNullSafe(F.col("__least.__hash"))
    names = [F.col("doc_id").alias("__id"), F.col("__hash").alias("__text")]
    gone = written(placed.where(~stays).select(*names).distinct())
    again = written(placed.where(stays).groupBy(*names).count().where(F.col("count") > 1))
    rows = docs.withColumn("__h", F.xxhash64(text))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__text"))
    left = rows.join(checked_broadcast(gone), same, "left_anti")
    if again.limit(1).count():
        side = checked_broadcast(again.select("__id", "__text"))
        single = left.join(side, same, "left_semi").dropDuplicates([doc_id, "__h"])
        left = left.join(side, same, "left_anti").unionByName(single)
    return left.drop("__h")

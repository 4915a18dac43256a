"""Suffix-array dedup: bytes covered by a string of 400 bytes, or another length, that starts elsewhere too.

Suffixes are dealt out by their content, so that equal strings meet in one task: each string of 400
bytes is named after the 16 bytes in it whose hash is least, its anchor. Anchors that occur once in
the corpus cannot belong to a repeated string and go first. What is left is sorted, task by task, by
the difference-cover method, limited to prefixes of 400 bytes:

1. positions that are 1 or 2 modulo 3 are a sample; they are sorted by triples of words and named;
2. triples of names, each three times as far apart as before, are sorted and named in turn, until
   names stand for 400 bytes or are all different;
3. the remaining suffixes are merged with those of either class by their first bytes and the name
   of the sampled suffix behind them;
4. neighbours in these orders are compared over 400 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variegate.llm.common import checked_broadcast, lean_batches, tidy, without, written

LENGTH = 400
LEAST_LENGTH = 64  # shorter strings have no room for anchors and names
GRAM = 16
PART = 1 << 20  # starts of a long text that are handled at once
PLACE_BITS = 22
MULTIPLIER = 0x9E3779B97F4A7C15
OTHER_MULTIPLIER = 0xD6E8FEB86659FD93
FILTER_BYTES = 1 << 25  # most that the filter of repeated anchors takes; beyond, it only sifts less
LARGE = 2048  # places of an anchor; beyond, its strings are dealt out by their hashes
SORTED_AT_ONCE = 1 << 19  # bytes; below 1 << 21 a sort of triples is one of single numbers
STRINGS_AT_ONCE = 1 << 18
_WORD = re.compile(rb"[^\x20\x09-\x0D]*[0-9A-Za-z\x80-\xFF][^\x20\x09-\x0D]*")
_INSIDE = re.compile(rb"[0-9A-Za-z\x80-\xFF]{2}")


class Hasher:
    """Polynomial hashes of all strings of one length in a text, modulo 2**64."""

    def __init__(self, size: int, seed: int = 1, multiplier: int = MULTIPLIER):
        ones = np.ones(1, np.uint64)
        inverse = np.uint64(pow(multiplier, -1, 1 << 64))
        factor = np.full(size, multiplier, np.uint64)
        self.powers = np.cumprod(np.concatenate([ones, factor]), dtype=np.uint64)
        self.inverse = np.cumprod(np.concatenate([ones, np.full(size, inverse)]), dtype=np.uint64)
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)

    def sums(self, text: np.ndarray) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.table[text] * self.powers[:len(text)], dtype=np.uint64, out=out[1:])
        return out

    def strings(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        found = (sums[length:] - sums[:-length]) * self.inverse[:n]
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        found ^= found >> np.uint64(32)
        return found


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(hasher: Hasher, raw: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """For parts of a text: ``(name, place, first, last)`` of each anchor.

    first and last are the first and last start of the strings whose anchor it is: the leftmost
    gram of least hash. Each start is in one such range.
    """
    keep = np.uint64((1 << 64) - (1 << PLACE_BITS))
    for low in range(0, len(raw) - length + 1, PART):
        part = np.frombuffer(raw, np.uint8, min(PART + length - 1, len(raw) - low), low)
        grams = hasher.strings(hasher.sums(part), GRAM)
        ordered = (grams & keep) | np.arange(len(grams), dtype=np.uint64)
        chosen = (sliding_least(ordered, length - GRAM + 1) & ~keep).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
        place = chosen[first]
        yield grams[place].view(np.int64), place + low, first + low, last + low


def _distinct_texts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """Keys and bytes of the texts of a task that are long enough, copies once."""
    seen = set()
    for batch in batches:
        firsts, seconds = batch["k1"].to_pylist(), batch["k2"].to_pylist()
        for k1, k2, text in zip(firsts, seconds, batch["text"]):
            if (k1, k2) in seen or not text.is_valid:
                continue
            seen.add((k1, k2))
            raw = text.as_buffer()
            if raw.size >= length:
                yield k1, k2, raw.to_pybytes()


def _anchor_counts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    hasher, held, size = Hasher(PART + length), [], 0

    def counted():
        names, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], names=["name", "n"])

    for _, _, raw in _distinct_texts(batches, length):
        for names, _, _, _ in anchors(hasher, raw, length):
            held.append(names)
            size += len(names)
        if size > 1 << 19:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def _filter_bits(names: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each name in a filter of ``bits`` bits, a power of two."""
    mixed = names.view(np.uint64) * np.uint64(0x94D049BB133111EB)
    return np.stack([mixed >> np.uint64(64 - bits), (mixed ^ (mixed >> np.uint64(31)))
                     & np.uint64((1 << bits) - 1)])


def repeated_filter(repeated: DataFrame, count: int, most: int = FILTER_BYTES) -> np.ndarray:
    """A Bloom filter of the anchors that are repeated, of at most ``most`` bytes.

    It lets some others pass, whose strings then prove to be single; it holds none back.
    """
    bits = max(13, min(int(most * 8).bit_length() - 1, (16 * count + 1).bit_length()))
    per_block = min(bits, 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            names = batch["name"].to_numpy()
            for places in _filter_bits(names, bits):
                of = (places >> np.uint64(per_block)).astype(np.int64)
                for block in np.unique(of):
                    held = blocks.setdefault(int(block), np.zeros(1 << per_block, bool))
                    held[(places[of == block] & np.uint64((1 << per_block) - 1))
                         .astype(np.int64)] = True
        for block, held in blocks.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([np.packbits(held).tobytes()], pa.binary())],
                names=["block", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << per_block) // 8
    found = repeated.select("name").coalesce(8).mapInArrow(run, "block long, bits binary")
    for block, held in found.toLocalIterator():
        out[block * size:(block + 1) * size] |= np.frombuffer(held, np.uint8)
    return out


def _stretches(sent, length: int):
    """Rows of each anchor that passes the filter, with the bytes of its strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        bits = (len(held) * 8).bit_length() - 1
        hasher, rows, size = Hasher(PART + length), [], 0

        def batch_of():
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["name", "k1", "k2", "lead", "first", "bytes"])

        for k1, k2, raw in _distinct_texts(batches, length):
            for names, places, first, last in anchors(hasher, raw, length):
                passed = np.ones(len(names), bool)
                for at in _filter_bits(names, bits):
                    passed &= (held[(at >> np.uint64(3)).astype(np.int64)]
                               >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
                for i in np.flatnonzero(passed).tolist():
                    part = raw[first[i]:last[i] + length]
                    rows.append((int(names[i]), k1, k2, int(places[i] - first[i]), int(first[i]),
                                 part))
                    size += len(part)
            if size > 1 << 23:
                yield batch_of()
                rows, size = [], 0
        if rows:
            yield batch_of()

    return run


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


RANGES = "bucket int, ranges binary"
RANGES_AT_ONCE = 1 << 17


def _packed_ranges(found: Iterator[list[tuple]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Ranges (k1, k2, first, last) of a task, packed by the bucket that their text is dealt to."""
    held: list[tuple] = []

    def pack():
        rows = np.array(held, np.int64).reshape(-1, 4)
        held.clear()
        bucket = (rows[:, 0] % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        parts = [own for own in np.split(order, cuts) if len(own)]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[own[0]]) for own in parts], pa.int32()),
             pa.array([rows[own].tobytes() for own in parts], pa.binary())],
            names=["bucket", "ranges"])

    for rows in found:
        held += rows
        if len(held) > RANGES_AT_ONCE:
            yield pack()
    yield pack()


def _merged_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of the buckets of a task, with its ranges in order, overlaps joined."""
    parts = [np.frombuffer(r, np.int64) for b in batches for r in b["ranges"].to_pylist()]
    rows = np.concatenate([np.zeros(0, np.int64), *parts]).reshape(-1, 4)
    rows = rows[np.lexsort(rows.T[::-1])]
    text = np.zeros(len(rows), np.int64)
    text[1:] = np.cumsum((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0))
    first, last = text << 40 | rows[:, 2], np.maximum.accumulate(text << 40 | rows[:, 3])
    new = np.ones(len(rows), bool)
    new[1:] = first[1:] > last[:-1] + 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(rows))[:len(starts)] - 1
    low, high = rows[starts, 2], last[ends] & ((1 << 40) - 1)
    owners = np.flatnonzero(np.diff(text[starts], prepend=-1))
    offsets = pa.array(np.append(owners, len(starts)).astype(np.int32))
    pairs = pa.StructArray.from_arrays([pa.array(low), pa.array(high)], names=["first", "last"])
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows[starts[owners], 0]), pa.array(rows[starts[owners], 1]),
         pa.ListArray.from_arrays(offsets, pairs)], names=["k1", "k2", "ranges"])


def _sorted_repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple]]:
    """Starts of repeated strings among stretches that come sorted by anchor."""
    waiting, size, current, name = [], 0, {}, None
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("name", "k1", "k2", "lead", "first", "bytes")]
        for own, k1, k2, lead, first, part in zip(*columns):
            if own != name:
                if current:
                    waiting.append(current)
                    size += sum(len(p) for _, p in current)
                if size > SORTED_AT_ONCE:
                    yield _repeats_of(waiting, length)
                    waiting, size = [], 0
                current, name = {}, own
            current.setdefault((lead, part), set()).add((k1, k2, first))
    if current:
        waiting.append(current)
    yield _repeats_of(waiting, length)


def _repeats_of(anchors_held: list[dict], length: int) -> list[tuple]:
    """For each anchor: stretches as (lead, bytes), with the places where they are."""
    out, pool, owners = [], [], []
    for stretches in anchors_held:
        single = []
        for (lead, part), places in stretches.items():
            if len(places) > 1:  # all of it is repeated
                last = len(part) - length
                out += [(k1, k2, first, first + last) for k1, k2, first in places]
            single.append((part, places))
        if len(single) > 1 and any(len(places) == 1 for _, places in single):
            pool += [part for part, _ in single]
            owners += [places for _, places in single]
    if pool:
        sizes = np.fromiter(map(len, pool), np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        text = np.frombuffer(b"".join(pool), np.uint8)
        inside = np.concatenate([np.arange(o, o + n - length + 1)
                                 for o, n in zip(offsets[:-1], sizes)])
        marks = repeated_starts(text, inside, length)
        cuts = np.cumsum(sizes - length + 1)[:-1]
        for own, places in zip(np.split(marks, cuts), owners):
            if len(places) == 1:
                (k1, k2, first), = places
                out += [(k1, k2, first + a, first + b) for a, b in _runs(own)]
    return out


def _packed(keys: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Keys of ``bits`` bits as one key where that fits in 63: one sort in place of several."""
    if bits * len(keys) > 63:
        return keys
    out = keys[0].astype(np.int64)
    for key in keys[1:]:
        out = out << bits | key
    return [out]


def _order(keys: list[np.ndarray]) -> np.ndarray:
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _named(keys: list[np.ndarray]) -> np.ndarray:
    """Names from 1 in the order of the keys; equal keys share a name."""
    order = _order(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        own = key[order]
        new[1:] |= own[1:] != own[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the string of ``length`` bytes at each start also begins at another start."""
    n = len(text)
    padded = np.zeros(n + 4 * length + 1000, np.uint8)
    padded[:n] = text
    words = np.zeros(len(padded) - 8, np.uint64)
    for i in range(8):
        words |= padded[i:i + len(words)].astype(np.uint64) << np.uint64(56 - 8 * i)
    bits = (len(padded) + 1).bit_length()
    word = _named([words])
    places = np.arange(n)
    sample = places[places % 3 != 0]
    names = np.zeros(len(padded), np.int64)
    names[sample] = _named(_packed([word[sample], word[sample + 8], word[sample + 16]], bits))
    size = 24  # bytes that a name stands for; a multiple of 3, so names behind are sampled too
    found = np.zeros(n, bool)
    while size < length:
        if names[sample].max(initial=0) == len(sample):
            return found[starts]  # no two suffixes share even so many bytes
        if size <= length - 3:  # with the bytes that lead to a sampled suffix
            shorter, reach = names.copy(), size
        triple = [names[np.minimum(sample + i * size, len(names) - 1)] for i in range(3)]
        names[sample] = _named(_packed(triple, bits))
        size *= 3
    kind = starts % 3
    zero, one, two = (starts[kind == k] for k in range(3))
    sampled = np.concatenate([one, two])
    orders = [(0, sampled[np.argsort(names[sampled])])]
    for others, lead in ((one, 1), (two, 2)):  # zeros merged with each class of the sample
        both = np.concatenate([zero, others])
        head = (words[both] >> np.uint64(64 - 8 * lead)).astype(np.int64)
        orders.append((lead, both[np.argsort(head << 40 | names[both + lead])]))
    # Neighbours are equal if their first and last words are, and so are names that reach from the
    # first to the last one.
    last = (length - reach) // 3 * 3 - 3
    behind = [*range(0, last, reach), last]
    for lead, order in orders:
        left, right = order[:-1], order[1:]
        for facts, at in ((words, 0), (words, length - 8),
                          *[(shorter, lead + offset) for offset in behind]):
            same = facts[left + at] == facts[right + at]
            left, right = left[same], right[same]
        found[left] = found[right] = True
    return found[starts]


def _string_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Strings of hot anchors as hashes, packed by anchor and part.

    Equal strings have their anchor at one distance from their start, so strings are dealt to
    parts by ranges of it, which keeps neighbouring starts together; where one distance is too
    many, by their hash as well.
    """
    hashers = [Hasher(2 * length, 2), Hasher(2 * length, 3, OTHER_MULTIPLIER)]
    for batch in batches:
        for low in range(0, len(batch), 1000):
            yield _packed_hashes(batch.slice(low, 1000), hashers, length)


def _packed_hashes(batch: pa.RecordBatch, hashers: list[Hasher], length: int) -> pa.RecordBatch:
    packed: dict[tuple, list] = {}
    columns = [batch[c].to_pylist() for c in ("name", "k1", "k2", "lead", "first", "n", "bytes")]
    for name, k1, k2, lead, first, n, part in zip(*columns):
        width = max(1, min(length - GRAM + 1, STRINGS_AT_ONCE // n))
        subs = -(-n * width // STRINGS_AT_ONCE)
        text = np.frombuffer(part, np.uint8)
        one, two = (h.strings(h.sums(text), length) for h in hashers)
        distance = lead - np.arange(len(one))
        dealt = distance // width * subs + (one % np.uint64(subs)).astype(np.int64)
        order = np.argsort(dealt, kind="stable")
        cuts = np.flatnonzero(np.diff(dealt[order])) + 1
        for own in np.split(order, cuts):
            packed.setdefault((name, int(dealt[own[0]])), []).append(
                ((k1, k2, first), own.astype(np.uint16), one[own], two[own]))
    rows = []
    for (name, part), strings in packed.items():
        rows.append((name, part, np.array([x[0] for x in strings], np.int64).tobytes(),
                     np.array([len(x[1]) for x in strings], np.int32).tobytes(),
                     *[np.concatenate([x[i] for x in strings]).tobytes() for i in (1, 2, 3)]))
    columns = list(zip(*rows)) or [()] * 7
    kinds = [pa.int64()] * 2 + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["name", "part", "places", "sizes", "offsets", "one", "two"])


PACKED = ("name long, part long, places binary, sizes binary, offsets binary, one binary, "
          "two binary")


def _hashed_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held, current = [], None
    for batch in batches:
        for i in range(len(batch)):
            own = batch["name"][i].as_py(), batch["part"][i].as_py()
            if held and own != current:
                yield _equal_hashes(held)
                held = []
            current = own
            held.append([batch[c][i].as_py() for c in ("places", "sizes", "offsets", "one", "two")])
    if held:
        yield _equal_hashes(held)


def _equal_hashes(held: list[list[bytes]]) -> list[tuple]:
    kinds = (np.int64, np.int32, np.uint16, np.uint64, np.uint64)
    places, sizes, offsets, one, two = (
        np.concatenate([np.frombuffer(row[i], kind) for row in held]) for i, kind in enumerate(kinds))
    places, keep, place = np.unique(places.reshape(-1, 3), axis=0, return_index=True,
                                    return_inverse=True)
    # a text that several tasks have sent counts once
    chosen = np.zeros(len(sizes), bool)
    chosen[keep] = True
    each = np.repeat(chosen, sizes)
    place = np.repeat(place.ravel(), sizes)[each]
    start, one, two = offsets[each].astype(np.int64), one[each], two[each]
    order = np.lexsort([two, one])
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    marked = np.zeros(len(one), bool)
    marked[order[1:][same]] = marked[order[:-1][same]] = True
    place, start = place[marked], start[marked]
    if not len(place):
        return []
    order = np.argsort(place << 16 | start)
    place, start = place[order], start[order]
    new = np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(place) - 1]])
    base = places[place[first], 2]
    return list(zip(places[place[first], 0].tolist(), places[place[first], 1].tolist(),
                    (base + start[first]).tolist(), (base + start[last]).tolist()))


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``k1, k2, ranges``: ranges of starts of repeated strings, for each text that has some.

    docs: k1, k2 (two hashes of the text), text. Copies are looked at once for each task.
    """
    context = docs.sparkSession.sparkContext
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("k1", "k2", "text")
    counts = texts.mapInArrow(tidy(lambda rows: _anchor_counts(rows, length)), "name long, n long") \
        .groupBy("name") \
        .agg(F.sum("n").alias("n"))
    repeated = written(counts.where(F.col("n") > 1))
    sent = context.broadcast(repeated_filter(repeated, repeated.count()))
    hot = written(repeated.where(F.col("n") > LARGE).select("name", "n"))
    stretches = texts.mapInArrow(
        tidy(_stretches(sent, length)), "name long, k1 long, k2 long, lead long, first long, bytes binary")
    # every stretch once, with the number of places where its anchor is hot
    known = written(stretches.join(checked_broadcast(hot), "name", "left"))
    few = known.where(F.col("n").isNull()).drop("n").repartition("name") \
        .sortWithinPartitions("name", "k1", "k2", "first") \
        .mapInArrow(tidy(lambda rows: _packed_ranges(_sorted_repeats(rows, length), buckets)), RANGES)
    many = known.where(F.col("n").isNotNull()) \
        .mapInArrow(tidy(lambda rows: _string_hashes(rows, length)), PACKED) \
        .repartition("name", "part").sortWithinPartitions("name", "part") \
        .mapInArrow(tidy(lambda rows: _packed_ranges(_hashed_repeats(rows), buckets)), RANGES)
    span = "array<struct<first: bigint, last: bigint>>"
    return few.unionByName(many).repartition(buckets, "bucket") \
        .mapInArrow(tidy(_merged_ranges), f"k1 long, k2 long, ranges {span}")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH,
                   least_words: int | None = None) -> DataFrame:
    """Every row of ``docs`` with what remains of its text.

    Adds ``kept binary`` (the bytes that remain), ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``removed array<struct<start, end>>``, maximal runs of removed bytes. A byte goes if it lies
    in a string of ``length`` bytes that also starts elsewhere, in another row or the same; overlaps
    count, and all strings are judged on the input. A null text is empty: nothing is removed and
    kept is empty. Copies of a text of ``length`` bytes or more lose all of it. Rows are kept as they
    are, repeats too; columns named like the added ones are replaced. With ``least_words`` only runs
    of that many whole words go, and those of 400 bytes or more.
    """
    if length < LEAST_LENGTH:
        raise ValueError(f"strings of {length} bytes; {LEAST_LENGTH} is the least")
    lean_batches(docs.sparkSession)
    docs = without(docs, "kept", "n_bytes", "n_removed", "n_spans", "removed")
    keyed = docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(1), text)})
    keys = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"),
                       F.col(text).alias("text"))
    ranges = repeated_strings(keys, length).withColumnRenamed("ranges", "__ranges")
    copied = keys.where(F.octet_length("text") >= length).groupBy("k1", "k2").count() \
        .where(F.col("count") > 1).select("k1", "k2", F.lit(True).alias("__copied"))
    facts = written(ranges.join(copied, ["k1", "k2"], "full")
                    .withColumnsRenamed({"k1": "__f1", "k2": "__f2"}))
    joined = keyed.join(facts, (F.col("__k1") == F.col("__f1")) & (F.col("__k2") == F.col("__f2")),
                        "left").drop("__f1", "__f2", "__k1", "__k2")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([
        *docs.schema.fields, T.StructField("kept", T.BinaryType()),
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("removed", T.ArrayType(span))])
    return joined.mapInArrow(tidy(_cutter(text, length, least_words)), schema)


def readable(kept: Column) -> Column:
    """What remains as a string, without the halves of characters that a cut has left."""
    @F.pandas_udf("string")
    def read(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: None if p is None else bytes(p).decode("utf-8", "ignore"))

    return read(kept)


def covered(ranges: list[dict], n_bytes: int, copied: bool,
            length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes within strings that start in any of the ranges."""
    if copied:
        return [(0, n_bytes)] if n_bytes else []
    out: list[tuple[int, int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in ranges or ()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def _holds(raw: bytes, start: int, end: int, least_words: int) -> bool:
    """Whether a run has ``LENGTH`` bytes or so many whole words; signs alone are none."""
    if end - start >= LENGTH:
        return True
    halved = sum(bool(_INSIDE.fullmatch(raw[at - 1:at + 1])) for at in (start, end) if at)
    return len(_WORD.findall(raw[start:end])) - halved >= least_words


def _cutter(text: str, length: int, least_words: int | None):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, spans = [], [], []
            for value, ranges, copied in zip(batch[text], batch["__ranges"], batch["__copied"]):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                runs = covered(ranges.as_py(), len(raw), bool(copied.as_py()), length)
                if least_words is not None:
                    runs = [(a, b) for a, b in runs if _holds(raw, a, b, least_words)]
                ends = [0, *[b for _, b in runs]]
                kept.append(b"".join(raw[a:b] for a, b in
                                     zip(ends, [*[a for a, _ in runs], len(raw)])))
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in runs])
            names = [c for c in batch.schema.names if c not in ("__ranges", "__copied")]
            left = pa.array([len(k) for k in kept], pa.int64())
            total = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in names], pa.array(kept, pa.binary()), total,
                 pa.array(np.array(sizes, np.int64) - left.to_numpy()),
                 pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(span))],
                names=[*names, "kept", "n_bytes", "n_removed", "n_spans", "removed"])

    return run

"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

Texts are normalised to words with one blank between and around them, so an occurrence of a
window always covers whole words. A text is scanned once; the place of a match gives the word,
and the words' places in the original text give the offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variegate.llm.common import lean_batches, tidy, without, written

# What separates words, in bytes; every byte from 0x80 belongs to a word.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in a text of either case
WINDOW = 10
# One automaton is built from at most so many bytes of windows; more windows make more automata.
AUTOMATON_BYTES = 4_000_000


def _byte_map() -> bytes:
    out = bytearray(range(256))
    for i in range(ord("A"), ord("Z") + 1):
        out[i] = i + 32
    for i in SEPARATORS:
        if not ord("A") <= i <= ord("Z"):
            out[i] = 32
    return bytes(out)


BYTE_MAP = _byte_map()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTE_MAP).split()


def windows_of(text: str | None, n: int = WINDOW) -> set[str]:
    words = words_of(text)
    if not words:
        return set()
    return {" ".join(w.decode("latin-1") for w in words[i:i + n])
            for i in range(max(1, len(words) - n + 1))}


def item_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """``window, items``: each different window once, with the sorted ids of its items.

    Windows are normalised words as latin-1, one character for each byte. Null and wordless
    items have none. A null id is left out of ``items``, but its windows count as hits.
    """
    schema = T.StructType([T.StructField("window", T.StringType()),
                           T.StructField("item", T.StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, i) for i, t in zip(batch["item"].to_pylist(), batch["text"].to_pylist())
                    for w in windows_of(t, n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)],
                names=["window", "item"])

    named = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return named.mapInArrow(split, schema).groupBy("window") \
        .agg(F.sort_array(F.collect_set("item")).alias("items"))


def mark_contamination(docs: DataFrame, items: DataFrame, text: str = "text",
                       n: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with the words and items found.

    Adds ``n_words``, ``n_hit``, ``hit_items array<string>`` (sorted) and ``hit_spans
    array<struct<start, end>>``: maximal runs of hit words as offsets in the original text, in
    code points. A null or wordless text has none of them. Rows are kept as they are, repeats
    too. Items give as many automata as they have multiples of ``AUTOMATON_BYTES`` of windows;
    each is broadcast, and the rows pass one after the other in the same task, without a
    shuffle. Columns of ``docs`` that are named like these are replaced.
    """
    lean_batches(docs.sparkSession)
    docs = without(docs, "n_words", "n_hit", "hit_items", "hit_spans")
    windows = written(item_windows(items, n).withColumn("bytes", F.length("window") + 64))
    total = windows.agg(F.sum("bytes")).first()[0] or 0
    parts = -(-total // AUTOMATON_BYTES) or 1
    found = docs.withColumn("__hits", F.lit(None).cast("array<int>")) \
        .withColumn("__items", F.lit(None).cast("array<string>")) \
        .withColumn("__words", F.lit(0).cast("long"))
    for part in range(parts):
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        rows = own.select("window", "items").collect()  # at most about AUTOMATON_BYTES
        sent = docs.sparkSession.sparkContext.broadcast([(r[0], list(r[1])) for r in rows])
        found = found.mapInArrow(tidy(_scanner(sent, text)), found.schema)
    return found.mapInArrow(tidy(_finisher(text)), _with_results(docs))


def _with_results(docs: DataFrame) -> T.StructType:
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()),
                         T.StructField("n_hit", T.LongType()),
                         T.StructField("hit_items", T.ArrayType(T.StringType())),
                         T.StructField("hit_spans", T.ArrayType(span))])


def _replaced(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in names], names=names)


def _scanner(sent, text: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        patterns = sent.value
        machine = ahocorasick.Automaton()
        for k, (window, _) in enumerate(patterns):
            machine.add_word(f" {window} ", k)
        if patterns:
            machine.make_automaton()
        sizes = [window.count(" ") + 1 for window, _ in patterns]
        for batch in batches:
            hits, items, n_words = [], [], []
            for value, old_hits, old_items in zip(batch[text].to_pylist(),
                                                  batch["__hits"].to_pylist(),
                                                  batch["__items"].to_pylist()):
                words = words_of(value)
                n_words.append(len(words))
                line = b" %b " % b" ".join(words)
                found = list(machine.iter(line.decode("latin-1"))) if patterns and words else []
                if not found:
                    hits.append(old_hits)
                    items.append(old_items)
                    continue
                blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                last = np.searchsorted(blanks, [end for end, _ in found]) - 1
                size = np.array([sizes[k] for _, k in found])
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, last - size + 1, 1)
                np.add.at(covered, last + 1, -1)
                own = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
                hits.append(np.union1d(own, np.array(old_hits or [], np.int64)).tolist())
                names = set(old_items or ())
                for k in {k for _, k in found}:
                    names.update(patterns[k][1])
                items.append(sorted(names))
            yield _replaced(batch, {"__hits": pa.array(hits, pa.list_(pa.int32())),
                                    "__items": pa.array(items, pa.list_(pa.string())),
                                    "__words": pa.array(n_words, pa.int64())})

    return scan


def _finisher(text: str):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            hits = [h or [] for h in batch["__hits"].to_pylist()]
            items = [i or [] for i in batch["__items"].to_pylist()]
            spans = [spans_of(t, h) if h else [] for t, h in zip(batch[text].to_pylist(), hits)]
            kept = [c for c in batch.schema.names if c not in ("__hits", "__items", "__words")]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in kept], batch["__words"],
                 pa.array([len(h) for h in hits], pa.int64()),
                 pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(span))],
                names=[*kept, "n_words", "n_hit", "hit_items", "hit_spans"])

    return finish


def spans_of(text: str, hits: list[int]) -> list[dict]:
    """Runs of consecutive words as offsets in ``text``."""
    places = [m.span() for m in WORD.finditer(text)]
    cuts = np.flatnonzero(np.diff(hits) > 1) + 1
    return [{"start": places[run[0]][0], "end": places[run[-1]][1]}
            for run in np.split(np.array(hits), cuts)]


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)

"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A blank is the marker, and a text begins with one. A character without a piece is spelled in byte
pieces. No piece reaches across words, so each word is segmented on its own, once for many texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variegate.llm import lattice
from variegate.llm.common import lean_batches, tidy, without

# Blanks with the word after them; a line feed is a word of its own.
WORD = re.compile(rb"\xff+[^\xff\n]*|[^\xff\n]+|\n")
WORDS_HELD = 100_000  # in a task; beyond, what is known of words is dropped and found again
TOKENS_AT_ONCE = 100_000
ROWS_AT_ONCE = 500  # of a batch, so that what a task holds besides it stays small


def split_words(text: str) -> list[bytes]:
    line = b" " + text.encode("utf-8", "surrogatepass")
    return WORD.findall(line.replace(b" ", lattice.BLANK))


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(low, ROWS_AT_ONCE)


def encode(docs: DataFrame, vocabulary: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids array<int>``.

    Null for a null text; an empty text has no pieces. Any string decodes to itself, the
    marker's own character and control characters included. Rows are kept as they are. The
    trie is broadcast: its size is that of the vocabulary. A column ``piece_ids`` is replaced.
    """
    lean_batches(docs.sparkSession)
    docs = without(docs, "piece_ids")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = docs.withColumn("piece_ids", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of: dict[bytes, bytes] = {}

        def learn(tokens):
            new = set(tokens) - pieces_of.keys()
            if len(pieces_of) + len(new) > WORDS_HELD:
                pieces_of.clear()
                new = set(tokens)
            new = list(new)
            pieces_of.update(zip(new, lattice.best_pieces(sent.value, new)))

        def encoded(held):
            learn([t for words in held for t in words])
            return [b"".join(map(pieces_of.__getitem__, words)) for words in held]

        for batch in in_slices(batches):
            blobs, held, size = [], [], 0
            for value in batch[text]:
                value = value.as_py()
                words = split_words(value) if value else []
                if len(words) > TOKENS_AT_ONCE:  # one very long text, in parts
                    blobs += encoded(held)
                    held, size = [], 0
                    parts = [words[i:i + TOKENS_AT_ONCE]
                             for i in range(0, len(words), TOKENS_AT_ONCE)]
                    blobs.append(b"".join(encoded([p])[0] for p in parts))
                    continue
                held.append(words)
                size += len(words)
                if size >= TOKENS_AT_ONCE:
                    blobs += encoded(held)
                    held, size = [], 0
            blobs += encoded(held)
            sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(blobs), np.int32))
            missing = np.array([not v.is_valid for v in batch[text]], bool)
            ids = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(missing, False)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids],
                                             names=[*batch.schema.names, "piece_ids"])

    return docs.mapInArrow(tidy(run), schema)


def decode(rows: DataFrame, vocabulary: dict, ids: str = "piece_ids") -> DataFrame:
    """``rows`` with ``decoded string``: byte pieces as bytes, markers as blanks, without the first.

    Null for null ids, empty for none. Ids that the vocabulary does not hold raise an error;
    bytes that are no UTF-8 become the replacement character. A column ``decoded`` is replaced.
    """
    rows = without(rows, "decoded")
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary["names"])
    schema = rows.withColumn("decoded", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value], object)
        for batch in in_slices(batches):
            out = []
            for value in batch[ids]:
                if not value.is_valid:
                    out.append(None)
                    continue
                own = value.values.to_numpy()
                if len(own) and own.min() < 0:
                    raise IndexError(f"no piece has the id {own.min()}")
                text = b"".join(names[own])
                out.append(text[text.startswith(b" "):].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())],
                                             names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(tidy(run), schema)



def fallbacks(ids: Column, low: int, high: int) -> Column:
    """How many of the ids are byte pieces, whose ids run from ``low`` to ``high``; 0 for null."""
    counted = F.size(F.filter(ids, lambda i: (i >= low) & (i <= high)))
    return F.when(ids.isNotNull(), counted).otherwise(0).cast("long")

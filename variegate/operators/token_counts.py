"""Tokens of texts as a model with a public merge list counts them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variegate.functions.byte_pairs import merged, words
from variegate.session import cut_lineage
from variegate.sources.schemas import QUERY_KEYS

# Words that are looked up without a shuffle: the most frequent, so many at most and of so many
# characters. All others meet their lengths by a join.
KNOWN_WORDS = 100_000
KNOWN_CHARS = 64


def word_lengths(df: DataFrame, text: str, ranks: dict[bytes, int]) -> DataFrame:
    """``word, n_rows, n_tokens`` for every different word of the texts, written.

    Words are counted by Spark, each is merged once. The ranks are broadcast; their size is that of
    the merge list.
    """
    found = df.where(F.col(text).isNotNull()).select(F.explode(words(F.col(text))).alias("word")) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n_rows"))
    sent = df.sparkSession.sparkContext.broadcast((ranks, max(map(len, ranks))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, longest = sent.value
        for batch in batches:
            counts = [len(merged(w.encode("utf-8", "surrogatepass"), own, longest))
                      for w in batch["word"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())],
                                             names=[*batch.schema.names, "n_tokens"])

    done = cut_lineage(found.mapInArrow(run, "word string, n_rows long, n_tokens long"))
    sent.unpersist()
    return done


def token_totals(df: DataFrame, keys: list[str], text: str, ranks: dict[bytes, int],
                 known: int = KNOWN_WORDS) -> DataFrame:
    """``keys, n_texts, n_tokens``: texts that are not null, and their tokens, for every key.

    A null text has no tokens and is not counted; an empty one is counted and has none. Texts are
    gone through twice: for their different words, and to add up the words' tokens. Frequent words
    are looked up in a table of at most ``known`` rows, the others in a shuffle by word. Sums are
    combined before they are shuffled, so neither a key nor a word that is in most rows is hot.
    """
    lengths = word_lengths(df, text, ranks)
    short = F.char_length("word") <= KNOWN_CHARS
    level = F.floor(F.log2("n_rows")).cast("int")
    sizes = sorted(lengths.groupBy(F.when(short, level).alias("level")).count().collect(),
                   key=lambda r: -1 if r["level"] is None else r["level"], reverse=True)
    least, taken, left = 64, 0, 0
    for r in sizes:
        if r["level"] is not None and not left and taken + r["count"] <= known:
            least, taken = r["level"], taken + r["count"]
        else:
            left += r["count"]
    frequent = short & (level >= least)
    rows = df.select(*keys, F.col(text).isNotNull().alias("__there"),
                     F.posexplode_outer(words(F.col(text))).alias("__at", "word"))
    looked_up = rows.join(F.broadcast(lengths.where(frequent).select("word", "n_tokens")), "word", "left")
    first = F.when(F.col("__there") & (F.coalesce("__at", F.lit(0)) == 0), 1).otherwise(0)
    parts = looked_up.select(*keys, first.alias("n_texts"), "n_tokens")
    if left:
        rare = looked_up.where(F.col("n_tokens").isNull() & F.col("word").isNotNull()) \
            .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("__n"))
        others = lengths.where(~frequent).select("word", F.col("n_tokens").alias("__size"))
        parts = parts.union(rare.join(others, "word").select(
            *keys, F.lit(0), F.col("__n") * F.col("__size")))
    return parts.groupBy(*keys).agg(F.sum("n_texts").cast("long").alias("n_texts"),
                                    F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def answer_length_tokens(answers: DataFrame, ranks: dict[bytes, int],
                         keys: list[str] | None = None) -> DataFrame:
    """Mean number of a model's tokens per answer; null for a query without answers."""
    keys = keys or QUERY_KEYS
    return token_totals(answers, keys, "answer", ranks).select(
        *keys, (F.col("n_tokens") / F.when(F.col("n_texts") > 0, F.col("n_texts")))
        .alias("answer_length"))

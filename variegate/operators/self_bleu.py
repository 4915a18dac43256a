"""Self-BLEU: how well each answer of a group is covered by the others, on average.

An n-gram that occurs c times in an answer is clipped at the most it occurs in any other
answer. Numbering the occurrences 1..c turns this into a count: the k-th occurrence is
clipped when no other answer has a k-th occurrence of the same n-gram. So one count per
(n-gram, k) finds everything to subtract, with no pair of answers ever formed: over all tasks for a
large group, and by sorting numbers for the groups of a task, some thousand answers at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from variegate.functions.words import Tokenizer, whitespace_tokens, word_tokens
from variegate.operators.grouping import key_fields, runs_of_groups, scores_of, split_by_size

# Fixed value: stands for a numerator of zero (smoothing method 1 of Chen and Cherry, 2014).
EPSILON = 0.1

# Answers of a group that are counted in one task.
SMALL = 2000

# Tokens that are counted at once, by whole groups; a group of more is counted alone.
TOKENS_AT_ONCE = 1 << 18


def self_bleu(df: DataFrame, keys: list[str], text: str = "answer", order: str = "answer_idx",
              max_n: int = 4, smoothing: bool = True, tokenizer: Tokenizer = word_tokens,
              queries: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """``keys, score``; 0 for groups of fewer than two answers.

    Two answers of a group at one position are an error. Groups of up to ``small`` answers are
    brought together once, by their text, and counted where they are; those of larger ones meet
    by n-gram.
    """
    rows = df.where(F.col(text).isNotNull()).select(*keys, order, text)
    groups = split_by_size(rows, keys, small)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scores = _scores(groups.small.repartition(partitions, *keys), keys, text, order, max_n,
                     smoothing, tokenizer, counted_in_task)
    if groups.large is not None:
        scores = scores.unionByName(_scores(groups.large.drop("group_size"), keys, text, order,
                                            max_n, smoothing, tokenizer, counted_by_gram))
    return scores if queries is None else scores_of(queries, scores, keys)


def _scores(rows: DataFrame, keys: list[str], text: str, order: str, max_n: int, smoothing: bool,
            tokenizer: Tokenizer, count) -> DataFrame:
    answers = answer_precisions(rows, keys, text, order, max_n, smoothing, tokenizer, count)
    if count is counted_in_task:
        answers = answers.repartition(*keys)  # once, for all that follows
    by_length = answers.groupBy(*keys, "length").agg(
        F.sum("precision").alias("precision"), F.count(F.lit(1)).alias("n"))
    return by_length.withColumn("penalty", _brevity_penalty(keys)) \
        .groupBy(*keys).agg(
            F.sum(F.col("precision") * F.col("penalty")).alias("total"),
            F.sum("n").alias("n")) \
        .select(*keys, F.when(F.col("n") < 2, 0.0)
                .otherwise(F.col("total") / F.col("n")).alias("score"))


def answer_precisions(df: DataFrame, keys: list[str], text: str, order: str, max_n: int,
                      smoothing: bool, tokenizer: Tokenizer, count=None) -> DataFrame:
    """``keys, order, length, precision``: the geometric mean of the clipped precisions."""
    answer = [*keys, order]
    tokens = df.where(F.col(text).isNotNull()) \
        .select(*answer, tokenizer(F.lower(text)).alias("tokens"))
    if tokenizer not in (word_tokens, whitespace_tokens):
        # n-grams are joined by blanks, so no token may hold one
        tokens = tokens.withColumn("tokens", F.transform(
            "tokens", lambda token: F.replace(token, F.lit(" "), F.lit("\x1f"))))
    counted = (count or counted_by_gram)(tokens, keys, order, max_n)
    logs = F.lit(0.0)
    matches = []
    for n in range(1, max_n + 1):
        total = F.greatest(F.col("length") - (n - 1), F.lit(0))
        matched = total - F.col(f"alone_{n}")
        matches.append(matched)
        floor = EPSILON if smoothing else sys.float_info.min
        shown = F.when(matched == 0, F.lit(floor)).otherwise(matched.cast("double"))
        if smoothing:
            precision = shown / F.greatest(total, F.lit(1))
        else:
            precision = F.when(matched == 0, shown).otherwise(shown / F.greatest(total, F.lit(1)))
        logs = logs + F.log(precision) / max_n
    precision = F.when(matches[0] == 0, 0.0).otherwise(F.exp(logs))
    return counted.select(*answer, "length", precision.alias("precision"))


def _grams(tokens: DataFrame, answer: list[str], order: str, max_n: int) -> DataFrame:
    """``answer, length, n, grams``. Grams of n = 0 are the answer's position alone: no other
    answer has it, and it carries the answer's length."""
    columns = ["tokens"]
    for n in range(2, max_n + 1):
        columns.append(f"__grams_{n}")
        tokens = NGram(n=n, inputCol="tokens", outputCol=columns[-1]).transform(tokens)
    name = F.array(F.col(order).cast("string"))
    of_each = F.array(*[F.struct(F.lit(n).alias("n"), grams.alias("grams")) for n, grams in
                        enumerate([name, *[F.col(column) for column in columns]])])
    return tokens.select(*answer, F.size("tokens").alias("length"), F.inline(of_each)) \
        .where(F.size("grams") > 0)


def _numbered(counted: DataFrame, answer: list[str]) -> DataFrame:
    """``answer, n, gram, occurrence``: one row for each of the ``times`` of a gram."""
    first = F.when(F.col("n") == 0, F.col("length")).otherwise(1)
    last = F.when(F.col("n") == 0, F.col("length")).otherwise(F.col("times"))
    return counted.select(*answer, "n", "gram",
                          F.explode(F.sequence(first, last)).alias("occurrence"))


def counted_by_gram(tokens: DataFrame, keys: list[str], order: str, max_n: int) -> DataFrame:
    """``keys, order, length, alone_1 ...``: how many occurrences no other answer has, for each n.

    The n-grams of a group meet over all tasks.
    """
    answer = [*keys, order]
    unshared = occurrences(tokens, answer, order, max_n) \
        .groupBy(*keys, "n", "gram", "occurrence").agg(
            F.count(F.lit(1)).alias("holders"), F.min(order).alias(order)) \
        .where((F.col("holders") == 1) | (F.col("n") == 0))
    problem = F.raise_error(F.concat(F.lit("two answers at position "),
                                     F.col(order).cast("string")))
    length = F.max(F.when(F.col("n") == 0, F.col("occurrence")))
    at_place = F.sum(F.when(F.col("n") == 0, F.col("holders")))
    return unshared.groupBy(*answer).agg(
        F.when(at_place == 1, length).otherwise(problem.cast("int")).alias("length"),
        *[F.count(F.when(F.col("n") == n, 1)).alias(f"alone_{n}") for n in range(1, max_n + 1)])


def counted_in_task(tokens: DataFrame, keys: list[str], order: str, max_n: int) -> DataFrame:
    """The same for rows that lie by group already, without rows for n-grams."""
    names = ["length", *[f"alone_{n}" for n in range(1, max_n + 1)]]
    schema = T.StructType([*key_fields(tokens, keys), tokens.schema[order],
                           *[T.StructField(name, T.LongType()) for name in names]])
    types = to_arrow_schema(schema)

    def counted(parts: list[pa.RecordBatch], groups: list[int]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        group = np.repeat(groups, [len(part) for part in parts])
        _check_places(group, rows[order])
        lists = rows["tokens"].combine_chunks()
        words = lists.flatten().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        lengths = np.diff(lists.offsets.to_numpy())
        found = [lengths, *alone_counts(group, lengths, words, max_n)]
        return pa.RecordBatch.from_arrays(
            [rows[c].combine_chunks().cast(types.field(c).type) for c in (*keys, order)]
            + [pa.array(own, pa.int64()) for own in found], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, groups, size, current = [], [], 0, None
        for batch in batches:
            for name, part in runs_of_groups(batch, keys):
                name = tuple("nan" if value != value else value for value in name)
                if held and name != current:
                    if size > TOKENS_AT_ONCE:
                        yield counted(held, groups)
                        held, groups, size = [], [], 0
                    groups.append(groups[-1] + 1 if groups else 0)
                else:
                    groups.append(groups[-1] if groups else 0)
                current = name
                held.append(part)
                size += len(part["tokens"].flatten())
        if held:
            yield counted(held, groups)

    return tokens.select(*keys, order, "tokens").sortWithinPartitions(*keys) \
        .mapInArrow(run, schema)


def _check_places(group: np.ndarray, places: pa.ChunkedArray) -> None:
    names = places.combine_chunks().dictionary_encode("encode").indices.to_numpy()
    _, first, times = np.unique(group.astype(np.int64) * len(names) + names, return_index=True,
                                return_counts=True)
    if (times > 1).any():
        raise ValueError(f"two answers at position {places[int(first[times > 1][0])].as_py()}")


def alone_counts(group: np.ndarray, lengths: np.ndarray, words: np.ndarray,
                 max_n: int) -> list[np.ndarray]:
    """For each n, the occurrences in each answer that no other answer of its group has.

    Answers stand by group; ``words`` are the numbers of their tokens, answer by answer. An n-gram
    is numbered by the (n-1)-gram that it begins with and its last word.
    """
    n_answers = len(lengths)
    owner = np.repeat(np.arange(n_answers), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(len(words))  # words from here to the answer's end
    at, gram, out = np.arange(len(words)), words, []
    for n in range(1, max_n + 1):
        if n > 1:
            kept = left[at] >= n
            at = at[kept]
            pairs = gram[kept] * (words.max(initial=0) + 1) + words[at + n - 1]
            gram = np.unique(pairs, return_inverse=True)[1]
        held, times = np.unique(gram * n_answers + owner[at], return_counts=True)
        holder, name = held % n_answers, held // n_answers
        starts = np.flatnonzero(np.diff(name, prepend=-1).astype(bool)
                                | np.diff(group[holder], prepend=-1).astype(bool))
        alone = np.zeros(n_answers, np.int64)
        if len(starts):
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(held))))
            most = np.maximum.reduceat(times, starts)
            first = times == most[run]
            second = np.maximum.reduceat(np.where(first, 0, times), starts)
            single = np.add.reduceat(first.astype(np.int64), starts) == 1
            tops = first & single[run]  # a gram that several have as often is shared all over
            alone = np.bincount(holder[tops], (most - second)[run[tops]], n_answers).astype(np.int64)
        out.append(alone)
    return out


def occurrences(tokens: DataFrame, answer: list[str], order: str, max_n: int) -> DataFrame:
    """``answer, n, gram, occurrence`` for every n up to ``max_n``, without a shuffle.

    Within a row, sorted grams stand in runs, and a run of k is numbered 1..k.
    """
    grams = _grams(tokens, answer, order, max_n) \
        .select(*answer, "length", "n", F.sort_array("grams").alias("grams"))
    gram = F.col("grams")
    starts = F.filter(F.sequence(F.lit(0), F.size(gram) - 1),
                      lambda i: (i == 0) | (F.get(gram, i) != F.get(gram, i - 1)))
    marked = grams.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size(gram)))
    runs = F.zip_with("starts", ends, lambda start, end: F.struct(
        F.get(gram, start).alias("gram"), (end - start).alias("times")))
    return _numbered(marked.select(*answer, "length", "n", F.inline(runs)), answer)


def _brevity_penalty(keys: list[str]) -> Column:
    """By the closest length among the other answers, the shorter one on a tie."""
    window = Window.partitionBy(*keys).orderBy("length")
    length = F.col("length")
    below, above = F.lag("length").over(window), F.lead("length").over(window)
    nearest = F.when(F.col("n") > 1, length) \
        .when(below.isNull(), above).when(above.isNull(), below) \
        .when(length - below <= above - length, below).otherwise(above)
    return F.when(length == 0, 0.0).when(length >= nearest, 1.0) \
        .otherwise(F.exp(1 - nearest / length))

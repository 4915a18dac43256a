"""Tasks, queries and answers: the joins and counts between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variegate.functions.lists import render_numbered
from variegate.functions.prompts import (chat_messages, contextualized, custom_id,
                                         embedding_request, judge_question, rating_request,
                                         split_answer_id, split_query_id)
from variegate.functions.words import Tokenizer, token_count, word_tokens
from variegate.operators.grouping import null_safe_join
from variegate.sources.schemas import QUERY_KEYS

# Positions of a query that one task numbers.
BLOCK = 4096


def with_task_context(tasks: DataFrame, answers: DataFrame, strict: bool = False) -> DataFrame:
    """Answers with their task and query; strict makes a query without an entry an error."""
    if not strict:
        return answers.join(tasks, QUERY_KEYS, "inner")
    joined = tasks.join(answers.withColumn("__found", F.lit(True)), QUERY_KEYS, "left")
    name = F.concat_ws("-", *[F.col(key).cast("string") for key in QUERY_KEYS])
    problem = F.raise_error(F.concat(F.lit("no answers for query "), name))
    found = F.coalesce("__found", problem.cast("boolean"))
    return joined.where(found).drop("__found")


def generation_messages(tasks: DataFrame, model: str, n_items: int | None = None) -> DataFrame:
    return tasks.withColumn("messages", chat_messages(
        F.lit(model), F.col("task_prompt"), F.col("query"), n_items))


def contextualize(df: DataFrame, answer_only: bool = False) -> DataFrame:
    """Add ``text``, what is to be embedded for each answer."""
    text = F.col("answer") if answer_only \
        else contextualized(F.col("task_prompt"), F.col("query"), F.col("answer"))
    return df.withColumn("text", text)


def judge_prompts(tasks: DataFrame, answers: DataFrame, strict: bool = False) -> DataFrame:
    """One question for every query of ``tasks``, with all its answers, numbered.

    A query without answers has an empty list, or is an error if ``strict`` and it has no row in
    ``answers`` at all. A prompt is one string, whatever its length; one that is over Spark's
    limit for a string fails, and :func:`judge_prompt_parts` gives it in pieces.
    """
    rows = F.sort_array(F.collect_list(F.when(
        F.col("answer").isNotNull(), F.struct("answer_idx", "answer"))))
    numbered = answers.groupBy(*QUERY_KEYS).agg(rows.alias("rows")).select(
        *QUERY_KEYS, F.size("rows").cast("long").alias("n_answers"),
        render_numbered(F.transform("rows", lambda row: row["answer"])).alias("numbered"))
    asked = with_task_context(tasks, numbered, strict=True) if strict \
        else tasks.join(numbered, QUERY_KEYS, "left")
    prompt = judge_question(F.col("task_prompt"), F.col("query"),
                            F.coalesce("numbered", F.lit("")))
    return asked.withColumn("n_answers", F.coalesce("n_answers", F.lit(0).cast("long"))) \
        .withColumn("prompt", prompt).drop("numbered")


def judge_prompt_parts(tasks: DataFrame, answers: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same prompts as ``part, text`` rows; the texts of a query in order make it up.

    Answers are numbered by their place among those of the query: within blocks of positions,
    and from the counts of the blocks before, so no task numbers a whole query.
    """
    present = answers.where(F.col("answer").isNotNull()) \
        .withColumn("__block", F.floor(F.col("answer_idx") / block))
    before = Window.partitionBy(*QUERY_KEYS).orderBy("__block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    starts = present.groupBy(*QUERY_KEYS, "__block").agg(F.count(F.lit(1)).alias("__n")) \
        .select(*QUERY_KEYS, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0))
                .alias("__before"))
    inside = Window.partitionBy(*QUERY_KEYS, "__block").orderBy("answer_idx", "answer")
    place = (F.col("__before") + F.row_number().over(inside)).alias("part")
    numbered = present.join(starts, [*QUERY_KEYS, "__block"]).select(*QUERY_KEYS, place, "answer")
    lead = F.when(F.col("part") == 1, F.lit("")).otherwise(F.lit(" "))
    item = F.concat(lead, F.col("part").cast("string"), F.lit(". "), F.col("answer"))
    heads = tasks.select(
        *QUERY_KEYS, F.lit(0).cast("long").alias("part"),
        judge_question(F.col("task_prompt"), F.col("query"), F.lit("")).alias("text"))
    known = tasks.select(*QUERY_KEYS)
    return heads.unionByName(numbered.select(*QUERY_KEYS, "part", item.alias("text"))
                             .join(known, QUERY_KEYS, "left_semi"))


def rating_requests(prompts: DataFrame, model: str, rubric: str | None = None) -> DataFrame:
    """One request for every prompt."""
    return prompts.select(*rating_request(
        custom_id(F.col("task_name"), F.col("query_idx")), F.lit(model), F.col("prompt"),
        rubric))


def ratings_by_query(ratings: DataFrame, tasks: DataFrame) -> DataFrame:
    """Ratings with the keys of their query in place of ``custom_id``.

    The id holds the task's name and the query; ratings of unknown queries are left out, and
    tasks must differ in name.
    """
    parts = split_query_id(F.col("custom_id"))
    named = tasks.select("task_name", *QUERY_KEYS)
    return ratings.withColumn("task_name", parts["task_name"]) \
        .withColumn("query_idx", parts["query_idx"]) \
        .join(named, ["task_name", "query_idx"]) \
        .select(*QUERY_KEYS, *[c for c in ratings.columns if c != "custom_id"])


def embeddings_from_responses(responses: DataFrame, embedding_model: str, generation_model: str,
                              answer_only: bool = False) -> DataFrame:
    """The embeddings table from ``custom_id, embedding``; the id holds run and keys."""
    key = split_answer_id(F.col("custom_id"))
    return responses.select(
        key["env"].alias("env"), F.lit(embedding_model).alias("embedding_model"),
        F.lit(generation_model).alias("generation_model"), F.lit(answer_only).alias("answer_only"),
        *[key[name].alias(name) for name in (*QUERY_KEYS, "answer_idx")],
        F.col("embedding").cast("array<float>").alias("embedding"))


def embedding_requests(df: DataFrame, env: str, model: str) -> DataFrame:
    """One request per answer row with a ``text``."""
    request_id = custom_id(F.lit(env), *[F.col(c) for c in (*QUERY_KEYS, "answer_idx")])
    return df.where(F.col("text").isNotNull()).select(
        *embedding_request(request_id, F.lit(model), F.col("text")))


def correlate_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every request with its response; ``is_answered`` is false where there is none."""
    marked = responses.withColumn("is_answered", F.lit(True))
    return requests.join(marked, "custom_id", "left") \
        .withColumn("is_answered", F.coalesce("is_answered", F.lit(False)))


def answer_counts(answers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Answers per query, zero included."""
    return answers.groupBy(*(keys or QUERY_KEYS)).agg(F.count("answer").alias("n_answers"))


def answer_length(answers: DataFrame, keys: list[str] | None = None,
                  tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """Mean number of tokens per answer; null for a query without answers."""
    return answers.groupBy(*(keys or QUERY_KEYS)).agg(
        F.avg(token_count(F.col("answer"), tokenizer)).alias("answer_length"))


def nest(df: DataFrame, value: str, order: str = "answer_idx",
         keys: list[str] | None = None, slice_size: int | None = None) -> DataFrame:
    """Values of each group as one ordered array; a group without values has an empty one.

    With ``slice_size`` a group comes as rows of at most so many values, numbered by ``part``,
    cut by place and not by position.
    """
    keys = keys or QUERY_KEYS
    pairs = F.sort_array(F.collect_list(F.when(
        F.col(order).isNotNull(), F.struct(order, value))))
    if slice_size is None:
        part, rows = [], df
    else:
        part = ["part"]
        rows = _numbered(df, order, keys).withColumn(
            "part", F.floor(F.coalesce("__place", F.lit(0)) / slice_size).cast("int"))
    return rows.groupBy(*keys, *part).agg(pairs.alias("pairs")) \
        .select(*keys, *part, F.transform("pairs", lambda pair: pair[value]).alias("items"))


def _numbered(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """``__place``, from 0, of each row among those of its group; null where the order is.

    Rows are numbered within blocks of positions, and from the counts of the blocks before.
    """
    block = F.floor(F.col(order) / BLOCK).alias("__block")
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.where(F.col(order).isNotNull()).groupBy(*keys, block) \
        .agg(F.count(F.lit(1)).alias("__n")) \
        .select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    ranked = df.withColumn("__block", block).withColumn("__rank", F.row_number().over(inside) - 1)
    return null_safe_join(ranked, starts, [*keys, "__block"], "left") \
        .withColumn("__place", F.when(F.col(order).isNotNull(), F.col("__before") + F.col("__rank"))) \
        .drop("__block", "__rank", "__before")


def pending_answers(answers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Answers that have no vector yet."""
    done = embeddings.where(F.col("embedding").isNotNull())
    return answers.where(F.col("answer").isNotNull()) \
        .join(done, [*QUERY_KEYS, "answer_idx"], "left_anti")


def assemble_scores(*tables: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Full outer join of keyed one-row-per-query tables, by one shuffle for all of them."""
    keys = keys or QUERY_KEYS
    names = [c for table in tables for c in table.columns if c not in keys]
    if len(set(names)) < len(names):
        raise ValueError(f"column in more than one table: {names}")
    stacked = None
    for i, table in enumerate(tables):
        marked = table.withColumn("__table", F.lit(i))
        stacked = marked if stacked is None \
            else stacked.unionByName(marked, allowMissingColumns=True)
    most = F.greatest(*[F.count(F.when(F.col("__table") == i, 1)) for i in range(len(tables))],
                      F.lit(0))
    merged = stacked.groupBy(*keys).agg(
        most.alias("__most"), *[F.max(name).alias(name) for name in names])
    problem = F.raise_error(F.lit("more than one row for a key in a score table"))
    unique = F.when(F.col("__most") <= 1, True).otherwise(problem.cast("boolean"))
    return merged.where(unique).select(*keys, *names)

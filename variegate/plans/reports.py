"""From a corpus to its scores, and from scores to their relation with ratings."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variegate.operators.diversity import diversity_score
from variegate.operators.embed import hashed_embedding
from variegate.operators.scoring import score
from variegate.operators.statistics import correlation_report, mean_ci
from variegate.operators.tasks import (answer_length, assemble_scores, contextualize,
                                       with_task_context)
from variegate.sources.schemas import QUERY_KEYS

METHODS = {"diversity": None, "self_bleu": 4, "ncd": None}


def score_answers(answers: DataFrame, keys: list[str], methods: dict[str, int | None] = METHODS,
                  queries: DataFrame | None = None) -> DataFrame:
    """``keys, method, arg_n, score`` by every method, vectors from hashed words.

    A query that is in ``answers`` without an answer, or in ``queries`` alone, scores 0.
    """
    scores = []
    listed = answers.select(*keys)
    queries = listed if queries is None else listed.union(queries.select(*keys))
    for method, arg_n in methods.items():
        rows, options = answers, {}
        if method == "diversity":
            rows = answers.where(F.col("answer").isNotNull())
            options = {"text": "answer", "embed": partial(hashed_embedding, text="answer")}
        scores.append(score(rows, keys, method, arg_n, queries=queries, **options))
    return reduce(DataFrame.unionByName, scores)


def context_diversity(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Diversity of each query's answers, read together with their question; 0 without answers."""
    texts = contextualize(with_task_context(tasks, answers.where(F.col("answer").isNotNull())))
    return diversity_score(texts, QUERY_KEYS, queries=tasks, text="text", embed=hashed_embedding)


def score_summary(scores: DataFrame, task: str) -> DataFrame:
    """Mean score with its interval, per method and task and per method over all."""
    return mean_ci(scores, "score", [task], within=["method"])


def score_rating_report(answers: DataFrame, ratings: DataFrame, keys: list[str], rating: str,
                        by: list[str], methods: dict[str, int | None] = METHODS) -> DataFrame:
    """Rank correlation of each score with a rating, plain and for equal answer length."""
    tables = [score_answers(answers, keys, {method: arg_n})
              .select(*keys, F.col("score").alias(method)) for method, arg_n in methods.items()]
    merged = assemble_scores(*tables, answer_length(answers, keys),
                             ratings.select(*keys, rating), keys=keys)
    return correlation_report(merged, list(methods), [rating], "answer_length", by)

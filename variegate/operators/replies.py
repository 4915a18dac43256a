"""Generation attempts: which reply of a query counts, which queries are still open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variegate.functions.lists import drop_truncated_tail, extract_items, head_items, strip
from variegate.functions.words import is_valid_list, stop_words
from variegate.sources.schemas import QUERY_KEYS

# Fixed value: rounds of generation before a query is given up.
MAX_ROUNDS = 20


def check_attempts(attempts: DataFrame, min_items: int | None = None,
                   max_items: int | None = None, min_tokens: int = 3,
                   language: str = "english", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Attempts with ``items`` and ``ok``; those outside the allowed rounds are never ok."""
    stop_words(language)
    in_time = F.coalesce((F.col("attempt") >= 0) & (F.col("attempt") < max_rounds), F.lit(False))
    parsed = attempts.withColumn("__in_time", in_time) \
        .withColumn("text", strip(F.col("text"))) \
        .withColumn("items", extract_items(F.col("text")))
    valid = is_valid_list(
        F.col("items"), F.col("finish_reason"), min_items, max_items, min_tokens, language)
    return parsed.withColumn("ok", F.col("__in_time") & valid) \
        .withColumn("in_time", F.col("__in_time")).drop("__in_time")


def select_replies(checked: DataFrame, max_items: int | None = None,
                   drop_truncated: bool = False,
                   keys: list[str] | None = None) -> DataFrame:
    """The first valid reply of each query; no text and no items where there is none.

    The last item of a reply that was cut off is kept unless ``drop_truncated``.
    """
    keys = keys or QUERY_KEYS
    kept = drop_truncated_tail(F.col("items"), F.col("finish_reason")) if drop_truncated \
        else F.col("items")
    reply = F.when(F.col("ok"), F.struct("attempt", "text",
                                         head_items(kept, max_items).alias("items")))
    first = checked.groupBy(*keys).agg(
        F.min_by(reply, F.when(F.col("ok"), F.col("attempt"))).alias("reply"))
    nothing = F.array().cast("array<string>")
    return first.select(*keys, "reply.attempt", "reply.text",
                        F.coalesce("reply.items", nothing).alias("items"))


def answers_of(replies: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per item of the selected replies; an empty list keeps one row."""
    return replies.select(*(keys or QUERY_KEYS),
                          F.posexplode_outer("items").alias("answer_idx", "answer"))


def pending_queries(queries: DataFrame, checked: DataFrame,
                    keys: list[str] | None = None) -> DataFrame:
    """Queries without a valid reply so far."""
    return queries.join(checked.where("ok"), keys or QUERY_KEYS, "left_anti")


def attempt_log(checked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The attempts that were needed: up to the first valid one of each query, in time."""
    keys = keys or QUERY_KEYS
    if "in_time" in checked.columns:
        checked = checked.where("in_time")
    first_ok = F.min(F.when(F.col("ok"), F.col("attempt"))).over(Window.partitionBy(*keys))
    needed = checked.withColumn("__first", first_ok) \
        .where(F.col("__first").isNull() | (F.col("attempt") <= F.col("__first")))
    return needed.select(*keys, "attempt", "ok", F.col("text").alias("raw_answer"),
                         F.col("items").alias("parsed_answer"),
                         F.current_timestamp().alias("logged_at"))


def attempt_summary(log: DataFrame) -> DataFrame:
    """Successes and failures per round."""
    return log.groupBy("attempt").agg(
        F.count(F.when(F.col("ok"), 1)).alias("n_ok"),
        F.count(F.when(~F.col("ok"), 1)).alias("n_failed"))

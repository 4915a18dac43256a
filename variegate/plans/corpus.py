"""The given tables seen as tasks, queries, answers, attempts and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variegate.functions.lists import render_numbered

DOCUMENT_KEYS = ["lang", "doc_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")


def numbered_lines(text: Column) -> Column:
    return render_numbered(lines(text), "\n")


def document_answers(documents: DataFrame) -> DataFrame:
    """Document = query, its lines = answers, language = task."""
    return documents.select(*DOCUMENT_KEYS, F.posexplode_outer(lines(F.col("text")))
                            .alias("answer_idx", "answer"))


def conversation_tasks(conversations: DataFrame) -> DataFrame:
    """Conversation = query, asked by its first user turn."""
    asked = F.when(F.col("role") == "user", F.col("turn"))
    return conversations.groupBy(F.col("conv_id").alias("query_idx")).agg(
        F.min_by("text", asked).alias("query")) \
        .select(F.lit(0).alias("task_idx"), F.lit("chat").alias("task_name"),
                F.lit("Reply to this turn: ").alias("task_prompt"), "query_idx",
                F.coalesce("query", F.lit("")).alias("query"))


def conversation_answers(conversations: DataFrame) -> DataFrame:
    """Assistant turns = answers, at their place among all turns."""
    return conversations.where(F.col("role") == "assistant").select(
        F.lit(0).alias("task_idx"), F.col("conv_id").alias("query_idx"),
        F.col("turn").cast("int").alias("answer_idx"), F.col("text").alias("answer"))


def conversation_attempts(conversations: DataFrame) -> DataFrame:
    """Assistant turns = attempts: their lines as a numbered list, cut off without a full stop."""
    finish = F.when(F.col("text").endswith("."), "stop").otherwise("length")
    return conversations.where(F.col("role") == "assistant").select(
        F.lit(0).alias("task_idx"), F.col("conv_id").alias("query_idx"),
        F.col("turn").cast("int").alias("attempt"),
        numbered_lines(F.col("text")).alias("text"), finish.alias("finish_reason"))


def vector_answers(embeddings: DataFrame) -> DataFrame:
    """Label = query, vector id = answer position."""
    return embeddings.select(F.lit(0).alias("task_idx"), F.col("label").alias("query_idx"),
                             F.col("vec_id").cast("int").alias("answer_idx"), "embedding")


def _hundred(conv_id: str) -> Column:
    """Documents of bounded size, more of them for more conversations."""
    return F.floor(F.col(conv_id) / 100).cast("long").alias("number")


def task_document(conversations: DataFrame) -> DataFrame:
    """Conversations as one task set in JSON for each hundred of their ids, as task files hold it."""
    asked = conversation_tasks(conversations)
    queries = asked.groupBy(_hundred("query_idx")).agg(
        F.sort_array(F.collect_list(F.struct("query_idx", "query"))).alias("queries"))
    task = F.struct(F.concat(F.lit("chat "), F.col("number").cast("string")).alias("task_name"),
                    F.lit("Chat").alias("task_name_original"), F.lit("Reply: ").alias("task_prompt"),
                    F.transform("queries", lambda q: q["query"]).alias("task_list"))
    return queries.select("number", F.to_json(F.array(task)).alias("value"))


def answer_document(conversations: DataFrame) -> DataFrame:
    """Assistant turns as nested answers in JSON for each hundred of ids, as answer files hold them."""
    said = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    answers = conversations.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(said)), lambda t: t["text"]).alias("answers"))
    queries = answers.groupBy(_hundred("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct("conv_id", "answers"))).alias("queries"))
    nested = F.array(F.transform("queries", lambda q: q["answers"]))
    return queries.select("number", F.to_json(nested).alias("value"))


def event_ledger(events: DataFrame) -> DataFrame:
    """Event = ledger entry, one file per user; a purchase is a completed batch."""
    status = F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    user = F.col("user_id").cast("string")
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("batch_"), F.col("event_id").cast("string")).alias("batch_id"),
        F.concat(F.lit("file_"), user).alias("input_file_id"),
        F.concat(F.lit("run_"), user, F.lit(".jsonl")).alias("input_file_name"),
        status.alias("status"))


def label_response_lines(labels: DataFrame) -> DataFrame:
    """Labels as chat responses in JSON: toxic ones by tool call, the others as content.

    Those that are toxic and of low quality hold no JSON.
    """
    quality, toxic = F.col("quality"), F.col("toxic")
    ratings = F.to_json(F.struct(
        (quality + 1).alias("Fluency"), (quality * 2 + toxic + 1).alias("Flexibility"),
        (quality * 0.5 + 2).alias("Originality"), (toxic + 2).alias("Elaboration"),
        (quality + toxic + 1).alias("Overall")))
    text = F.when((quality == 0) & (toxic == 1), "oops").otherwise(ratings)
    call = F.struct(F.struct(text.alias("arguments")).alias("function"))
    message = F.struct(F.when(toxic == 0, text).alias("content"),
                       F.when(toxic == 1, F.array(call)).alias("tool_calls"))
    choice = F.array(F.struct(message.alias("message")))
    response = F.struct(F.struct(choice.alias("choices")).alias("body"))
    custom_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return labels.select(F.to_json(F.struct(
        custom_id.alias("custom_id"), response.alias("response"))).alias("value"))


def vector_response_lines(embeddings: DataFrame) -> DataFrame:
    """Vectors as embedding responses in JSON."""
    custom_id = F.concat_ws("-", F.lit("my-env"), F.lit("0"), F.col("label").cast("string"),
                            F.col("vec_id").cast("string"))
    data = F.array(F.struct(F.col("embedding")))
    response = F.struct(F.struct(data.alias("data")).alias("body"))
    return embeddings.select(F.to_json(F.struct(
        custom_id.alias("custom_id"), response.alias("response"))).alias("value"))

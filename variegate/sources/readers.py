"""Readers. Positions become key columns here, at the scan, and nowhere else."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variegate.functions.ratings import rating_columns, rating_text
from variegate.operators.grouping import with_places
from variegate.sources import schemas
from variegate.sources.arrays import parsed, read_items

CORRUPT = "_corrupt_record"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A task set: one JSON array, of any size and in one or more parts, or flat parquet."""
    if _is_parquet(path):
        return spark.read.schema(schemas.TASKS).parquet(path)
    items = read_items(spark, path)
    tasks = items.select(F.col("at")[0].alias("task_idx"),
                         parsed(F.col("item"), schemas.TASK_JSON).alias("task"))
    return _queries_of(tasks)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers nested by task and query: one JSON array, of any size and in one or more parts, or
    flat parquet. A query without answers keeps one row with nulls."""
    if _is_parquet(path):
        return spark.read.schema(schemas.ANSWERS).parquet(path)
    items = read_items(spark, path, 2)
    return items.select(
        F.col("at")[0].alias("task_idx"), F.col("at")[1].alias("query_idx"),
        F.posexplode_outer(parsed(F.col("item"), "array<string>")).alias("answer_idx", "answer"))


def flatten_tasks(documents: DataFrame, column: str = "document") -> DataFrame:
    return _queries_of(documents.select(F.posexplode(column).alias("task_idx", "task")))


def _queries_of(tasks: DataFrame) -> DataFrame:
    return tasks.select(
        "task_idx", "task.task_name", "task.task_name_original", "task.task_prompt",
        F.posexplode("task.task_list").alias("query_idx", "query"))


def flatten_answers(documents: DataFrame, column: str = "document",
                    keep: list[str] | None = None) -> DataFrame:
    """One row per answer; a query without answers keeps one row with nulls."""
    kept = keep or []
    tasks = documents.select(*kept, F.posexplode(column).alias("task_idx", "queries"))
    queries = tasks.select(*kept, "task_idx",
                           F.posexplode("queries").alias("query_idx", "answers"))
    return queries.select(*kept, "task_idx", "query_idx",
                          F.posexplode_outer("answers").alias("answer_idx", "answer"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path)


def read_embedding_responses(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``custom_id, embedding``; the first vector of each response."""
    lines = _json_lines(spark, path, schemas.EMBEDDING_RESPONSE, strict)
    return lines.select("custom_id", first_embedding(F.col("response")).alias("embedding"))


def first_embedding(response: Column) -> Column:
    return F.get(response["body"]["data"], F.lit(0))["embedding"]


def read_rating_responses(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``custom_id``, five ratings and ``is_complete``; strict makes a bad row an error."""
    lines = _json_lines(spark, path, schemas.RATING_RESPONSE, strict)
    ratings = lines.select("custom_id", *rating_columns(first_message(F.col("response"))))
    return require_complete(ratings) if strict else ratings


def first_message(response: Column) -> Column:
    return rating_text(F.get(response["body"]["choices"], F.lit(0))["message"])


def require_complete(ratings: DataFrame) -> DataFrame:
    problem = F.raise_error(F.concat(F.lit("incomplete rating: "), F.col("custom_id")))
    return ratings.withColumn(
        "is_complete", F.when(F.col("is_complete"), True).otherwise(problem.cast("boolean")))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return _csv_by_name(spark, path, schemas.RATINGS)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores as CSV or as Parquet, whichever the path holds; run columns come along."""
    files = spark.read.format("binaryFile").load(path).inputFiles()
    if any(name.endswith(".parquet") for name in files):
        found = spark.read.parquet(path)
        return _typed(found, schemas.SCORES, [c for c in schemas.RUN_KEYS if c in found.columns])
    return _csv_by_name(spark, path, schemas.SCORES)


def _typed(df: DataFrame, schema: T.StructType, more: list[str]) -> DataFrame:
    missing = [name for name in schema.names if name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema], *more)


def _csv_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns are found by the names in the header, in any order; others are left out.

    A file whose header differs from that of the first one is an error, and so is a value that
    is not of its column's type.
    """
    names = spark.read.csv(path, header=True, escape='"').columns
    kinds = {f.name: f.dataType for f in schema}
    own = T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in names])
    rows = spark.read.schema(own).csv(path, header=True, escape='"', enforceSchema=False,
                                      mode="FAILFAST")
    return _typed(rows, schema, [])


def read_ledger(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The batch ledger; a missing one is empty unless ``strict``.

    ``seq`` counts the entries from 0 in the order of their times; of equal times the batch's id
    decides. Of a batch that was entered more than once the first entry counts.
    """
    try:
        entries = spark.read.schema(schemas.LEDGER_ENTRY).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as error:
        if strict or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.LEDGER)
    time = F.struct(F.coalesce("written_ns", F.lit(0)).alias("at"), "seq")  # older entries have no time
    first = entries.groupBy("batch_id").agg(
        F.min_by(F.struct("input_file_id", "input_file_name", "status"), time).alias("entry"),
        F.min(time).alias("time")).select("batch_id", "entry.*", "time")
    return with_places(first, ["time", "batch_id"]).select(
        F.col("__place").alias("seq"), *[c for c in schemas.LEDGER.names if c != "seq"])


def _is_parquet(path: str) -> bool:
    return not path.endswith((".json", ".json.gz"))


def parsed_documents(df: DataFrame, column: str, schema: str,
                     keep: list[str] | None = None) -> DataFrame:
    """``keep`` and ``document``, parsed from JSON text; text that is no document is an error."""
    parsed = F.from_json(column, schema, {"mode": "FAILFAST"})
    problem = F.raise_error(F.lit("not a JSON document of the expected form"))
    return df.select(*(keep or []), F.when(parsed.isNotNull(), parsed)
                     .otherwise(problem.cast(schema)).alias("document"))


def _json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool) -> DataFrame:
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(with_corrupt).json(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)

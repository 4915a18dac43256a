"""Writers. Parquet (zstd) is the native form, partitioned by the run that made it."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variegate.functions.prompts import request_line
from variegate.sources import schemas
from variegate.sources.arrays import write_nested


def write_answers(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write_parquet(df, path, mode)


def write_nested_answers(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Answers as one JSON array by task and query, in parts; a path that ends in ``.json`` is
    read again by ``read_answers``."""
    write_nested(df, path, mode=mode)


def write_embeddings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write_parquet(df, path, mode)


def with_run(df: DataFrame, env: str, generation_model: str, embedding_model: str | None = None,
             answer_only: bool = False) -> DataFrame:
    """Add the columns that say which run the rows belong to; writers partition by them."""
    return df.withColumns({
        "env": F.lit(env), "embedding_model": F.lit(embedding_model).cast("string"),
        "generation_model": F.lit(generation_model), "answer_only": F.lit(answer_only)})


def append_attempt_log(df: DataFrame, path: str) -> None:
    """Add the attempts of a round to the log."""
    _write_parquet(df, path, "append")


def write_scores(df: DataFrame, path: str, format: str = "csv",
                 mode: str = "errorifexists") -> None:
    if format == "csv":
        df.write.mode(mode).csv(path, header=True, escape='"')
    else:
        _write_parquet(df, path, mode)


def write_ratings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    names = [name for name in schemas.RATINGS.names if name in df.columns]
    df.select(*names).write.mode(mode).csv(path, header=True, escape='"')


def write_requests(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Requests as JSON lines; a body that is JSON text is written as an object."""
    if df.schema["body"].dataType.typeName() == "string":
        line = request_line(*[F.col(c) for c in ("custom_id", "method", "url", "body")])
        df.select(line.alias("value")).write.mode(mode).text(path)
    else:
        df.select("custom_id", "method", "url", "body").write.mode(mode).json(path)


def append_ledger(spark: SparkSession, path: str, batch_id: str, input_file_id: str,
                  input_file_name: str, status: str | None = None) -> None:
    """Add one entry. Any number of writers may do so at once, and again after a failure.

    Each writes a table of its own under ``path``, which nothing changes later. The reader puts
    entries in the order of their times and ids, and takes the first of a batch.
    """
    entry = spark.createDataFrame([(None, batch_id, input_file_id, input_file_name, status, time.time_ns())],
                                  schemas.LEDGER_ENTRY)
    entry.coalesce(1).write.parquet(f"{path}/entry-{uuid.uuid4()}")


def _write_parquet(df: DataFrame, path: str, mode: str) -> None:
    keys = [key for key in (*schemas.RUN_KEYS, "method") if key in df.columns]
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)

"""Look-ups in the batch ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_batch(ledger: DataFrame, input_file_name: str, pick: str = "first") -> DataFrame:
    """The entry of one file, the first by default; an error if there is none."""
    found = pick_batches(ledger.where(F.col("input_file_name") == input_file_name), pick)
    if found.isEmpty():
        raise ValueError(f"no entry in the ledger for {input_file_name}")
    return found


def pick_batches(ledger: DataFrame, pick: str = "first") -> DataFrame:
    """One entry per file name."""
    if pick not in ("first", "latest"):
        raise ValueError(f"pick is first or latest, not {pick}")
    choose = F.min_by if pick == "first" else F.max_by
    # two writers at once may give one number to both; the id of the batch then decides
    entry = choose(F.struct("seq", "batch_id", "input_file_id", "status"),
                   F.struct("seq", "batch_id"))
    return ledger.groupBy("input_file_name").agg(entry.alias("entry")) \
        .select("input_file_name", "entry.*")


def completed_batches(ledger: DataFrame, strict: bool = False) -> DataFrame:
    """Entries whose batch is done; strict makes any other status an error.

    Which entry of a file counts is chosen before, by :func:`pick_batches`.
    """
    done = F.col("status").eqNullSafe(F.lit("completed"))
    if not strict:
        return ledger.where(done)
    problem = F.raise_error(F.concat(F.lit("batch "), F.col("batch_id"),
                                     F.lit(" is not done, its status is "),
                                     F.coalesce("status", F.lit("unknown"))))
    return ledger.where(F.when(done, True).otherwise(problem.cast("boolean")))

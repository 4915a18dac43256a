"""Judge ratings inside a chat response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from variegate.functions.prompts import METRICS

RATING_SCHEMA = ", ".join(f"{metric} DOUBLE" for metric in METRICS)


def rating_text(message: Column) -> Column:
    """Arguments of the first tool call, else the content."""
    return F.coalesce(F.get(message["tool_calls"], F.lit(0))["function"]["arguments"],
                      message["content"])


def parse_ratings(text: Column) -> Column:
    return F.from_json(text, RATING_SCHEMA)


def rating_columns(text: Column) -> list[Column]:
    """The five metrics in lower case and whether all of them were found."""
    parsed = parse_ratings(text)
    complete = F.forall(F.array(*[parsed[m] for m in METRICS]), lambda v: v.isNotNull())
    return [parsed[m].alias(m.lower()) for m in METRICS] + [complete.alias("is_complete")]

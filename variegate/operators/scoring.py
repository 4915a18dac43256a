"""Scoring methods by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variegate.operators.compression_distance import compression_distance
from variegate.operators.diversity import diversity_score
from variegate.operators.self_bleu import self_bleu

Scorer = Callable[..., DataFrame]

_SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    """``scorer(df, keys, arg_n, **options)`` returns ``keys, score``."""
    _SCORERS[name] = scorer


def score(df: DataFrame, keys: list[str], method: str, arg_n: int | None = None,
          **options) -> DataFrame:
    """``keys, method, arg_n, score``"""
    if method not in _SCORERS:
        raise ValueError(f"no scoring method is named {method}")
    if method == "self_bleu" and arg_n is None:
        raise ValueError("self_bleu needs arg_n, its longest n-gram")
    scores = _SCORERS[method](df, keys, arg_n, **options)
    return scores.select(*keys, F.lit(method).alias("method"),
                         F.lit(arg_n).cast("int").alias("arg_n"), "score")


register_scorer("diversity", lambda df, keys, arg_n, **options:
                diversity_score(df, keys, max_items=arg_n, **options))
register_scorer("self_bleu", lambda df, keys, arg_n, **options:
                self_bleu(df, keys, max_n=arg_n, **options))
register_scorer("ncd", lambda df, keys, arg_n, **options:
                compression_distance(df, keys, **options))

"""Scores in SQL: a table function over the answers of a query.

    SELECT * FROM score(TABLE(answers) PARTITION BY (task_idx, query_idx), 'self_bleu', 4)

gives ``task_idx, query_idx, method, arg_n, score``. All columns of the table but ``answer_idx`` and
the answer itself name the query; what they are is known when the statement is analysed. A query's
answers go to one task and are held there, up to a limit; the DataFrame operators have none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from variegate.functions.compression import gzip_size
from variegate.operators.compression_distance import Unit, distance_sums
from variegate.operators.diversity import score_rows
from variegate.operators.self_bleu import EPSILON

ORDER, ANSWER, VECTOR = "answer_idx", "answer", "embedding"
MOST_ANSWERS = 20_000  # of a query; more are an error, which names the operators without a limit

_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")

# (answers in order, places, arg_n) to a score
Kernel = Callable[[list, list[int], int | None], float | None]


def _self_bleu(answers: list, places: list[int], max_n: int) -> float:
    """The mean over answers of the geometric mean of clipped precisions, times the penalty."""
    if len(answers) < 2:
        return 0.0
    lists = [a if isinstance(a, list) else [t for t in _BLANKS.split(a.lower()) if t] for a in answers]
    logs, first = np.zeros(len(lists)), np.zeros(len(lists))
    for n in range(1, max_n + 1):
        grams = [Counter(tuple(own[i:i + n]) for i in range(len(own) - n + 1)) for own in lists]
        most: dict[tuple, list[int]] = {}  # the two largest counts, the first one's owner
        for i, own in enumerate(grams):
            for gram, count in own.items():
                best = most.setdefault(gram, [0, -1, 0])
                if count > best[0]:
                    best[:] = [count, i, best[0]]
                elif count > best[2]:
                    best[2] = count
        for i, own in enumerate(grams):
            matched = sum(min(c, most[g][2] if most[g][1] == i else most[g][0]) for g, c in own.items())
            logs[i] += np.log((matched or EPSILON) / max(own.total(), 1)) / max_n
            if n == 1:
                first[i] = matched
    sizes = np.array([len(own) for own in lists])
    lengths, counts = np.unique(sizes, return_counts=True)
    total = 0.0
    for i, size in enumerate(sizes):
        others = lengths[(lengths != size) | (counts > 1)]
        nearest = min(others, key=lambda other: (abs(other - size), other))
        if size and first[i]:
            total += np.exp(logs[i]) * (1.0 if size >= nearest else np.exp(1 - nearest / size))
    return float(total / len(lists))


def _ncd(answers: list, places: list[int], _: int | None) -> float:
    where: dict[bytes, list[int]] = {}
    for place, text in zip(places, answers):
        where.setdefault(text.encode("utf-8"), []).append(place)
    units = [Unit(text, gzip_size(text), sorted(own)) for text, own in where.items()]
    found = distance_sums(units, None)
    return found["total"] / found["n_pairs"] if found["n_pairs"] else 0.0


def _diversity(vectors: list, places: list[int], max_items: int | None) -> float | None:
    kept = [v for v in vectors[:max_items] if v is not None]
    if len({len(v) for v in kept}) > 1:
        raise ValueError("vectors of different lengths in one group")
    matrix = np.array([[np.nan if c is None else c for c in v] for v in kept], float)
    return score_rows(matrix if kept else np.zeros((0, 0)), np.ones(len(kept)), 0)["score"]


KERNELS: dict[str, tuple[str, Kernel]] = {
    "diversity": (VECTOR, _diversity), "self_bleu": (ANSWER, _self_bleu), "ncd": (ANSWER, _ncd)}


@dataclass
class ScoreAnalysis(AnalyzeResult):
    """The result's columns, and what the rows of a query are read by."""

    keys: list[str] = field(default_factory=list)
    method: str = ""
    arg_n: int | None = None


class ScoreTable:
    """The table function; ``analyze`` looks at the statement, the rest runs for each query."""

    def __init__(self, analysis: ScoreAnalysis):
        self.keys, self.method, self.arg_n = analysis.keys, analysis.method, analysis.arg_n
        self.value, self.kernel = KERNELS[self.method]
        self.key: tuple | None = None
        self.rows: list[tuple] = []

    @staticmethod
    def analyze(table: AnalyzeArgument, method: AnalyzeArgument,
                arg_n: AnalyzeArgument | None = None) -> ScoreAnalysis:
        if not table.isTable:
            raise ValueError("the first argument of score is a table")
        if method.value not in KERNELS:
            raise ValueError(f"no scoring method is named {method.value}")
        n = None if arg_n is None else arg_n.value
        if method.value == "self_bleu" and n is None:
            raise ValueError("self_bleu needs arg_n, its longest n-gram")
        value = KERNELS[method.value][0]
        names = table.dataType.fieldNames()
        missing = [name for name in (ORDER, value) if name not in names]
        if missing:
            raise ValueError(f"columns missing: {missing}")
        keys = [f for f in table.dataType.fields if f.name not in (ORDER, ANSWER, VECTOR)]
        schema = T.StructType([*keys, T.StructField("method", T.StringType()),
                               T.StructField("arg_n", T.IntegerType()), T.StructField("score", T.DoubleType())])
        return ScoreAnalysis(schema, keys=[f.name for f in keys], method=method.value, arg_n=n)

    def eval(self, row, method, arg_n=None):
        key = tuple(row[name] for name in self.keys)
        if self.key is None:
            self.key = key
        elif key != self.key:
            raise ValueError(f"a partition holds rows of {self.key} and {key}: partition by {self.keys}")
        if row[self.value] is not None or self.method == "diversity" and row[ORDER] is not None:
            self.rows.append((row[ORDER], row[self.value]))
        if len(self.rows) > MOST_ANSWERS:
            raise ValueError(f"{key} has over {MOST_ANSWERS} answers: use variegate.operators.scoring.score")

    def terminate(self):
        if self.key is None:
            return
        self.rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
        places = [place for place, _ in self.rows]
        again = [p for p, n in Counter(places).items() if n > 1]
        if self.method == "self_bleu" and again:
            raise ValueError(f"two answers at position {again[0]}")
        yield (*self.key, self.method, self.arg_n, self.kernel([v for _, v in self.rows], places, self.arg_n))


def register_score_table(spark: SparkSession, name: str = "score") -> None:
    """Make ``name(TABLE(...) PARTITION BY ..., method[, arg_n])`` known to the session's SQL."""
    spark.udtf.register(name, udtf(ScoreTable))

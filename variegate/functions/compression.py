"""Length of a text after gzip compression."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

GZIP_FORMAT = 31
BEST_LEVEL = 9


def gzip_size(data: bytes) -> int:
    return len(zlib.compress(data, BEST_LEVEL, GZIP_FORMAT))


@F.pandas_udf(T.IntegerType())
def gzip_len(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else gzip_size(t.encode("utf-8"))).astype("Int32")

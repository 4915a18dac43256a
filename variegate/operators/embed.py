"""Vectors for texts, by hashed words or by a function of the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variegate.functions.words import Tokenizer, whitespace_tokens


def embed(df: DataFrame, text: str, function: Callable[[pd.Series], pd.Series],
          column: str = "embedding") -> DataFrame:
    """Add the vectors ``function`` makes of a batch of texts; null where it gives none."""
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{column: function(batch[text])})

    return df.mapInPandas(run, schema)


def hashed_embedding(df: DataFrame, text: str = "text", dimensions: int = 256,
                     column: str = "embedding",
                     tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """Counts of words and word pairs in hashed places; needs no model, never negative."""
    tokens = df.withColumn("__tokens", tokenizer(F.lower(text)))
    pairs = NGram(n=2, inputCol="__tokens", outputCol="__pairs").transform(tokens)
    features = pairs.withColumn("__features", F.concat("__tokens", "__pairs"))
    hashing = HashingTF(inputCol="__features", outputCol="__counts", numFeatures=dimensions)
    return hashing.transform(features) \
        .withColumn(column, vector_to_array("__counts", "float32")) \
        .drop("__tokens", "__pairs", "__features", "__counts")

"""The cleaning pipeline over ``documents``: stages of operators, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variegate.llm import decontamination, language, pieces, simhash, suffixes
from variegate.llm.common import apart, table
from variegate.llm.queries import VOCABULARY
from variegate.llm.vocabulary import read_vocabulary
from variegate.session import ensure_checkpoint_dir

LEAST_CHANCE = 0.5  # of the language found; every clear text is far above
LEAST_WORDS = 51  # of a repeated passage; they take 101 bytes at least, with a blank between them


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a language: those without a letter go, and those of no clear language.

    The model is learned from the documents' own languages. Null and empty texts have no letter.
    """
    model = language.fit(docs, read_vocabulary(VOCABULARY))
    rows, named = apart(docs, "text")
    clear = (F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_CHANCE)
    return language.predict(rows, model).where(clear).select(*named)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id.

    Near are texts whose fingerprints of three words in a row differ in at most three bits, directly
    or by way of others.
    """
    rows, named = apart(docs, "doc_id", "text")
    return simhash.keep_one(rows).select(*named)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere; n_chars counts what is left.

    Those are runs of over 50 words, or of 400 bytes, whose every string of 101 bytes is repeated. All documents stay, one that is all repeats as an empty text. Of a character that a cut
    divides nothing is left. Texts without a cut stay as they are, null too.
    """
    rows, named = apart(docs, "text", "n_chars")
    cut = F.col("n_removed") > 0
    found = suffixes.remove_repeats(rows, length=2 * LEAST_WORDS - 1, least_words=LEAST_WORDS) \
        .withColumn("text", F.when(cut, suffixes.readable(F.col("kept"))).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long"))
                            .otherwise(F.col("n_chars"))).select(*named)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    rows, named = apart(docs, "text")
    return decontamination.mark_contamination(rows, items).where(F.col("n_hit") == 0) \
        .select(*named)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``piece_ids`` (null for a null text), ``n_pieces`` and ``round_trip``.

    The last says whether the ids decode to the text.
    """
    vocabulary = read_vocabulary(VOCABULARY)
    docs, named = apart(docs, "text")
    rows = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    return rows.select(*named, "piece_ids",
                       F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language identification", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Fingerprints, trained chances and pieces cannot be expressed in SQL; the tests use loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs

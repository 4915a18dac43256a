"""Language identification by unigrams of pieces, summed over all segmentations of the words.

For each language the pieces of a fixed public vocabulary have chances, estimated by a few rounds
of expectation and maximisation. A text's likelihood is the product over its words of the sum over
all segmentations of a word, by the forward algorithm, since no piece reaches across words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variegate.llm import lattice
from variegate.llm.common import lean_batches, tidy, without, written

LETTER = regex.compile(r"\p{L}")
SAMPLE = 1500  # documents of each language that a model is fitted on
ROUNDS = 3
SMOOTHING = 200.0  # pieces' worth of the mean over languages that each language is mixed with
WORDS_HELD = 100_000  # in a task; beyond, what is known of words is dropped and found again
TOKENS_AT_ONCE = 100_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Languages in order, and the chance of each piece in each of them."""

    vocabulary: dict
    languages: list[str]
    chances: np.ndarray


def _letters_only() -> bytes:
    keep = b"abcdefghijklmnopqrstuvwxyz"
    return bytes(b if b in keep or b >= 0x80 else 32 for b in range(256))


LETTERS_ONLY = _letters_only()


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case; of ASCII only letters count, all other bytes below 0x80 separate."""
    if not text:
        return []
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTERS_ONLY).split()


def marked(words: list[bytes]) -> list[bytes]:
    return [lattice.BLANK + w for w in words]


def sampled(docs: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` documents of each language (all of them if fewer), by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    share = None
    for lang, count in counts.items():
        value = F.lit(int((1 << 30) * min(1.0, limit / count)))
        share = F.when(F.col("lang") == lang, value) if share is None \
            else share.when(F.col("lang") == lang, value)
    return known.where(F.lit(False) if share is None else place < share)


def fit(docs: DataFrame, vocabulary: dict, limit: int = SAMPLE,
        rounds: int = ROUNDS) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the rows of ``docs``; rows without either are left out.

    At most about ``limit`` documents of each language are used. Their words are counted by
    Spark; every round is a job over the counts, and what comes back is one number for each
    piece and language.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    words = written(sampled(docs, limit).select("lang", "text")
                    .mapInArrow(tidy(count), "lang string, word binary, n long")
                    .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    start = np.exp(np.where(np.isfinite(vocabulary["scores"]), vocabulary["scores"], -50.0))
    start[vocabulary["byte_ids"]] = 1e-6
    chances = np.repeat((start / start.sum())[:, None], len(languages), axis=1)
    context = docs.sparkSession.sparkContext
    for _ in range(rounds if languages else 0):
        sent = context.broadcast((vocabulary, languages, chances))
        found = words.mapInArrow(tidy(_expecting(sent)), "lang int, piece int, expected double") \
            .groupBy("lang", "piece").agg(F.sum("expected")).collect()
        counts = np.zeros_like(chances)
        for lang, piece, expected in found:
            counts[piece, lang] = expected
        mean = counts.sum(1) / counts.sum() * 0.999 + start / start.sum() * 0.001
        chances = (counts + SMOOTHING * mean[:, None]) / (counts.sum(0) + SMOOTHING)
        sent.unpersist()
    return LanguageModel(vocabulary, languages, chances)


def _expecting(sent):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, languages, chances = sent.value
        counts = np.zeros_like(chances)
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            words, weights = marked(batch["word"].to_pylist()), batch["n"].to_numpy()
            for k, lang in enumerate(languages):
                own = np.flatnonzero(langs == lang)
                if len(own):
                    counts[:, k] += lattice.expected_counts(
                        vocabulary, [words[i] for i in own], weights[own].astype(float),
                        np.ascontiguousarray(chances[:, k]))
        pieces, of = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(of.astype(np.int32)), pa.array(pieces.astype(np.int32)),
             pa.array(counts[pieces, of])], names=["lang", "piece", "expected"])

    return expect


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, the chance of that language among all.

    A text that is null, empty or without a letter is ``und`` with score 0, and so is every text
    for a model of no language. Texts with letters but no word known to any language are judged
    by their bytes. Of equal languages the first by name is taken. Rows are kept as they are.
    The model is broadcast: its size is that of the vocabulary times the languages. Columns of
    ``docs`` that are named like these are replaced.
    """
    lean_batches(docs.sparkSession)
    docs = without(docs, "lang_pred", "lang_score")
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.vocabulary, model.languages, model.chances))
    schema = docs.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, languages, chances = sent.value
        known: dict[bytes, int] = {}
        logs = np.zeros((0, len(languages)))
        for batch in batches:
            sums = np.zeros((len(batch), len(languages)))
            judged = np.zeros(len(batch), bool)
            texts, held, at = batch[text], [], []

            def settle():
                nonlocal logs
                tokens = [t for words in held for t in words]
                new = list(set(tokens) - known.keys())
                if len(known) + len(new) > WORDS_HELD:
                    known.clear()
                    new, logs = list(set(tokens)), logs[:0]
                known.update(zip(new, range(len(known), len(known) + len(new))))
                logs = np.concatenate([logs, lattice.log_sums(vocabulary, marked(new), chances)])
                places = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
                starts = np.cumsum([0, *map(len, held)])[:-1]
                np.add.at(sums, np.array(at), np.add.reduceat(logs[places], starts))
                held.clear()
                at.clear()

            size = 0
            for i in range(len(batch) if languages else 0):
                value = texts[i].as_py()
                if not value or not LETTER.search(value):
                    continue
                judged[i] = True
                words = words_of(value)
                for low in range(0, len(words), TOKENS_AT_ONCE):
                    part = words[low:low + TOKENS_AT_ONCE]
                    held.append(part)
                    at.append(i)
                    size += len(part)
                    if size >= TOKENS_AT_ONCE:
                        settle()
                        size = 0
            if held:
                settle()
            best = sums.argmax(1) if languages else np.zeros(len(batch), int)
            chance = np.exp(sums - sums.max(1, keepdims=True)) if languages else sums
            score = np.where(judged, 1 / np.maximum(chance.sum(1), 1.0), 0.0)
            names = [languages[b] if j else UNKNOWN for b, j in zip(best, judged)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score)],
                names=[*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(tidy(run), schema)

"""Sentence borders from a corpus itself: which full stops belong to an abbreviation.

The published unsupervised statistics of Kiss and Strunk (2006). A word is an abbreviation if it is
short and nearly always stands before a full stop, by a log-likelihood ratio that is scaled by its
length, its inner full stops and the times it stands without one. After an abbreviation a sentence
begins only with a word that is drawn to the places behind sure borders. All counts are sums over the
corpus; the words found are few, since both tests have a threshold, and go along with the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variegate.functions.lists import evaluated_once
from variegate.functions.words import whitespace_tokens, word_tokens
from variegate.session import cut_lineage

# The published thresholds and the chance of a full stop behind an abbreviation.
ABBREVIATION = 0.3
STARTER = 30.0
SURE = 0.99
LEAST = 1e-8  # added to chances before their logarithm

OPENING = r"""^[\[({<"'«“‘„]+"""
CLOSING = r"""[\])}>"'»”’]*$"""
HELD = "﷐"  # stands for a full stop that is no border; no character, so in no text


@dataclass(frozen=True)
class SentenceModel:
    abbreviations: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()


def bare(token: Column) -> Column:
    """A token without quotes, brackets and marks around it; a full stop at its end stays."""
    return F.regexp_replace(token, rf"""{OPENING}|[\])}}>"'»”’,;:!?]+$""", "")


def has_stop(core: Column) -> Column:
    return core.rlike(r"[^.]\.$")


def type_of(core: Column) -> Column:
    """The word in lower case, without the full stop at its end."""
    return F.lower(F.regexp_replace(core, r"\.+$", ""))


def may_end(token: Column) -> Column:
    """Whether a sentence can end with the token: one full stop, or any other end mark."""
    return token.rlike("[.!?]") & token.rlike(rf"(?:[^.]\.|[!?]){CLOSING}")


def token_pairs(df: DataFrame, text: str) -> DataFrame:
    """``token, before`` for all tokens of the texts; the first of a text has nothing before it."""
    tokens = whitespace_tokens(F.col(text))
    pairs = df.where(F.col(text).isNotNull()).select(tokens.alias("t")).select(F.explode(F.transform(
        "t", lambda t, i: F.struct(t.alias("token"), F.when(i > 0, F.get("t", i - 1)).alias("before"))))
        .alias("pair"))
    return pairs.select("pair.token", "pair.before")


def _log(chance: Column) -> Column:
    return F.log(chance + LEAST)


def abbreviation_statistics(df: DataFrame, text: str) -> DataFrame:
    """``type, n_stop, n_plain, score`` of every word that stands before a full stop.

    A word holds a letter. Tokens without one count among all tokens and full stops only.
    """
    # equal tokens are counted first: the patterns run once for each of them
    tokens = df.select(F.explode(whitespace_tokens(F.col(text))).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    core = bare(F.col("token"))
    stopped = tokens.select(type_of(core).alias("type"), has_stop(core).alias("stopped"), "n")
    counts = stopped.groupBy("type").agg(
        F.coalesce(F.sum(F.when(F.col("stopped"), F.col("n"))), F.lit(0)).alias("n_stop"),
        F.coalesce(F.sum(F.when(~F.col("stopped"), F.col("n"))), F.lit(0)).alias("n_plain"))
    counts = cut_lineage(counts)
    total, stops = counts.agg(F.sum(F.col("n_stop") + F.col("n_plain")), F.sum("n_stop")).first()
    chance = F.lit((stops or 0) / max(total or 0, 1))
    with_stop, plain = F.col("n_stop"), F.col("n_plain")
    by_chance = with_stop * _log(chance) + plain * _log(1 - chance)
    by_kind = with_stop * F.log(F.lit(SURE)) + plain * F.log(F.lit(1 - SURE))
    inner = F.char_length("type") - F.char_length(F.replace(F.col("type"), F.lit(".")))
    length = F.char_length("type") - inner
    score = 2 * (by_kind - by_chance) * F.exp(-length) * (inner + 1) * F.pow(length, -plain)
    return counts.where((with_stop > 0) & F.col("type").rlike(r"\p{L}")) \
        .select("type", "n_stop", "n_plain", score.alias("score"))


def starter_statistics(df: DataFrame, text: str, abbreviations: tuple[str, ...]) -> DataFrame:
    """``type, n_starts, n_all, score`` of every word that stands behind a sure border.

    Sure is an end mark other than the full stop of an abbreviation. The score is the log-likelihood
    ratio of the word and the border; it is 0 for a word that is no more frequent there than
    elsewhere.
    """
    before = F.col("before")
    known = type_of(bare(before)).isin(list(abbreviations)) if abbreviations else F.lit(False)
    sure = F.coalesce(may_end(before) & ~(known & has_stop(bare(before))), F.lit(False))
    tokens = token_pairs(df, text).groupBy("token", sure.alias("sure")) \
        .agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(tokens.groupBy(type_of(bare(F.col("token"))).alias("type")).agg(
        F.coalesce(F.sum(F.when(F.col("sure"), F.col("n"))), F.lit(0)).alias("n_starts"),
        F.sum("n").alias("n_all")))
    total, borders = counts.agg(F.sum("n_all"), F.sum("n_starts")).first()
    total, borders = float(total or 0), float(borders or 0)
    at, everywhere = F.col("n_starts"), F.col("n_all")
    inside, outside = at / max(borders, 1.0), (everywhere - at) / max(total - borders, 1.0)

    def likelihood(hits: Column, rest: Column, chance: Column) -> Column:
        return hits * _log(chance) + rest * _log(1 - chance)

    mean = everywhere / max(total, 1.0)
    behind, others = borders - at, (total - borders) - (everywhere - at)
    ratio = 2 * (likelihood(at, behind, inside) + likelihood(everywhere - at, others, outside)
                 - likelihood(at, behind, mean) - likelihood(everywhere - at, others, mean))
    return counts.where((at > 0) & F.col("type").rlike(r"\p{L}")).select(
        "type", "n_starts", "n_all", F.when(inside > mean, ratio).otherwise(0.0).alias("score"))


def fit_sentences(df: DataFrame, text: str) -> SentenceModel:
    """Abbreviations and sentence starters of a corpus; none from an empty one."""
    def named(rows: DataFrame, least: float) -> tuple[str, ...]:
        return tuple(sorted(r[0] for r in rows.where(F.col("score") >= least).select("type").collect()))

    abbreviations = named(abbreviation_statistics(df, text), ABBREVIATION)
    return SentenceModel(abbreviations,
                         named(starter_statistics(df, text, abbreviations), STARTER))


def _held_back(token: Column, following: Column, model: SentenceModel) -> Column:
    """Whether the full stop at the end of a token is that of an abbreviation within a sentence."""
    core = bare(token)
    if not model.abbreviations:
        return F.lit(False)
    mid = ~F.lit(False)
    if model.starters:
        begins = following.rlike(rf"""(?:{OPENING})?\p{{Lu}}""") \
            & type_of(bare(following)).isin(list(model.starters))
        mid = ~F.coalesce(begins, F.lit(False))
    # a text's last full stop ends its sentence, whatever it follows
    return F.contains(token, F.lit(".")) & has_stop(core) & may_end(token) & type_of(core).isin(list(model.abbreviations)) \
        & following.isNotNull() & mid


def trained_tokens(text: Column, model: SentenceModel) -> Column:
    """Treebank words; of full stops before white space only those at sentence borders are split off."""
    def join(tokens: Column) -> Column:
        kept = F.transform(tokens, lambda t, i: F.when(
            _held_back(t, F.get(tokens, i + 1), model),
            F.regexp_replace(t, rf"\.({CLOSING})", f"{HELD}$1")).otherwise(t))
        return F.array_join(kept, " ")

    joined = evaluated_once(whitespace_tokens(text), join)
    return F.transform(evaluated_once(joined, word_tokens), lambda t: F.replace(t, F.lit(HELD), F.lit(".")))


def sentences(text: Column, model: SentenceModel) -> Column:
    """The sentences of a text, their words separated by one blank; none of an empty text."""
    def mark(tokens: Column) -> Column:
        return F.transform(tokens, lambda t, i: F.when(
            may_end(t) & ~_held_back(t, F.get(tokens, i + 1), model), F.concat(t, F.lit(HELD))).otherwise(t))

    cut = F.split(F.array_join(evaluated_once(whitespace_tokens(text), mark), " "), HELD)
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")

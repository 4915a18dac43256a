import math
from collections import Counter

import numpy as np
import pytest

from variegate.functions.words import whitespace_tokens
from variegate.operators.scoring import register_scorer, score
from variegate.operators.self_bleu import self_bleu


def frame(spark, groups):
    return spark.createDataFrame([(k, i, t) for k, texts in groups.items()
                                  for i, t in enumerate(texts)],
                                 "k string, answer_idx int, answer string")


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def published_bleu(references, hypothesis, max_n):
    logs = 0.0
    for n in range(1, max_n + 1):
        own = grams(hypothesis, n)
        most = Counter()
        for reference in references:
            most |= grams(reference, n)
        matched = sum((own & most).values())
        if n == 1 and matched == 0:
            return 0.0
        logs += math.log((matched or 0.1) / max(1, sum(own.values()))) / max_n
    size = len(hypothesis)
    closest = min((abs(len(r) - size), len(r)) for r in references)[1]
    return math.exp(logs) * (1 if size >= closest else math.exp(1 - closest / size))


def by_definition(texts, max_n):
    tokens = [t.lower().split() for t in texts]
    if len(tokens) < 2:
        return 0.0
    return float(np.mean([published_bleu(tokens[:i] + tokens[i + 1:], tokens[i], max_n)
                          for i in range(len(tokens))]))


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_against_the_definition(spark, max_n):
    rng = np.random.default_rng(5)
    groups = {f"r{g}": [" ".join(rng.choice(list("abcdE"), size=rng.integers(1, 14)))
                        for _ in range(rng.integers(1, 9))] for g in range(12)}
    groups |= {"same": ["a b c d e"] * 3, "apart": ["a b", "c d"], "one": ["a b c"],
               "blank": ["", "a"], "mixed": ["the the the the", "the cat", "the the dog sat on"]}
    found = {r["k"]: r["score"] for r in self_bleu(
        frame(spark, groups), ["k"], max_n=max_n, tokenizer=whitespace_tokens).collect()}
    assert found == pytest.approx({k: by_definition(t, max_n) for k, t in groups.items()},
                                  abs=1e-12)
    assert found["same"] == pytest.approx(1)
    assert all(0 <= v <= 1 for v in found.values())


def test_without_smoothing(spark):
    df = frame(spark, {"a": ["x y z", "x y w"]})
    value = self_bleu(df, ["k"], max_n=3, smoothing=False).first()["score"]
    assert value == pytest.approx((2 / 3 * 1 / 2 * 2.2250738585072014e-308) ** (1 / 3))


def test_registry(spark):
    df = frame(spark, {"a": ["x y", "x y"]})
    row = score(df, ["k"], "self_bleu", 2).first()
    assert (row["method"], row["arg_n"], row["score"]) == ("self_bleu", 2, pytest.approx(1))
    with pytest.raises(ValueError, match="no scoring method is named x"):
        score(df, ["k"], "x")
    with pytest.raises(ValueError, match="self_bleu needs arg_n"):
        score(df, ["k"], "self_bleu")

    def longest(rows, keys, arg_n):
        return rows.groupBy(*keys).applyInPandas(
            lambda g: g[["k"]].head(1).assign(score=float(g.answer.str.len().max())),
            "k string, score double")

    register_scorer("longest", longest)
    assert score(df, ["k"], "longest").first()["score"] == 3.0


def test_ways_agree(spark):
    """Groups counted in one place, and by n-gram."""
    rng = np.random.default_rng(5)
    groups = {k: [" ".join(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in range(n)]
              for k, n in (("x", 30), ("y", 3), ("z", 1))}
    df = frame(spark, groups)
    one = {r["k"]: r["score"] for r in self_bleu(df, ["k"]).collect()}
    other = {r["k"]: r["score"] for r in self_bleu(df, ["k"], small=2).collect()}
    assert one.keys() == other.keys() == groups.keys()
    for k in groups:
        assert one[k] == pytest.approx(other[k], abs=1e-12)


@pytest.mark.parametrize("small", [1, 2000])
def test_repeated_position(spark, small):
    for second in ("a b", "a b c"):
        df = spark.createDataFrame([("k", 0, "a b"), ("k", 0, second)],
                                   "k string, answer_idx int, answer string")
        with pytest.raises(Exception, match="two answers at position 0"):
            self_bleu(df, ["k"], small=small).collect()


def test_many_groups_at_once(spark, monkeypatch):
    """Counted some groups at a time, all in one go, or by gram: the same, with nulls among the keys."""
    from variegate.operators import self_bleu as module
    rng = np.random.default_rng(8)
    rows = [(None if g == 3 else g, float("nan") if g % 4 == 0 else g % 4 / 2, i,
             " ".join(rng.choice(list("abcde"), rng.integers(0, 20))))
            for g in range(40) for i in range(rng.integers(1, 30))]
    df = spark.createDataFrame(rows, "k long, l double, answer_idx int, answer string").repartition(3)

    def scores(**options):
        found = self_bleu(df, ["k", "l"], tokenizer=whitespace_tokens, **options).collect()
        return {(r["k"], str(r["l"])): r["score"] for r in found}

    one, other = scores(), scores(small=0)
    monkeypatch.setattr(module, "TOKENS_AT_ONCE", 10)
    assert len(one) == 40
    assert one == pytest.approx(other, abs=1e-12) and scores() == pytest.approx(one, abs=1e-12)


def test_no_rows_for_grams_of_small_groups(spark, capsys):
    """The n-grams of small groups are counted in their task: nothing is exploded, one row an answer."""
    df = frame(spark, {"a": ["x y z"] * 3})
    self_bleu(df, ["k"]).explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "MapInArrow" in plan


def test_null_key_with_queries(spark):
    df = spark.createDataFrame([(None, 0, "a b c d"), (None, 1, "a b c e"), ("k", 0, "x")],
                               "k string, answer_idx int, answer string")
    plain = {r["k"]: r["score"] for r in self_bleu(df, ["k"]).collect()}
    listed = {r["k"]: r["score"] for r in self_bleu(df, ["k"], queries=df).collect()}
    assert plain == listed and plain[None] > 0


def test_tokens_with_blanks(spark):
    from pyspark.sql import functions as F
    df = frame(spark, {"k": ["a b,c", "a,b c"]})
    found = self_bleu(df, ["k"], max_n=2, tokenizer=lambda text: F.split(text, ","))
    assert found.first()["score"] == 0.0  # no token is shared

"""Byte-pair merging and token totals, against a naive merger and a public tokenizer."""

import base64
import random

import pytest
from conftest import DATA

from variegate.functions.byte_pairs import PATTERN, merged, read_ranks, words
from variegate.operators.token_counts import answer_length_tokens, token_totals
from variegate.plans.catalog import MERGES


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(MERGES)


def naive(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Look at all neighbours, join the first pair of least rank, and begin again."""
    parts = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def public(texts):
    import tiktoken

    with open(MERGES, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return [len(encoding.encode_ordinary(t)) for t in texts]


def test_merging_equals_the_naive_merger(ranks):
    longest, rng = max(map(len, ranks)), random.Random(3)
    known = rng.sample(sorted(ranks), 300)
    drawn = [bytes(rng.choice(b"aabbctheing .") for _ in range(rng.randrange(60))) for _ in range(300)]
    for word in [b"", b"a", b"aaaa" * 9, "größer 東京".encode(), *known, *drawn]:
        assert merged(word, ranks, longest) == naive(word, ranks)
    assert all(merged(token, ranks, longest) == [token] for token in known)


def test_long_word_takes_no_quadratic_time(ranks):
    word = b"ab" * 200_000
    assert b"".join(merged(word, ranks, max(map(len, ranks)))) == word


def test_ties_take_the_first_pair():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 301}
    assert merged(b"aaaaa", ranks, 3) == [b"aa", b"aaa"] == naive(b"aaaaa", ranks)


def test_words_make_up_the_text(spark):
    texts = ["It's  a\n\n test,\tno? end ", " ", "", "x1y2 'll"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(words(rows.t)).collect()]
    assert ["".join(w) for w in found] == texts
    assert found[0][:4] == ["It", "'s", " ", " a"]


def test_totals_of_documents_equal_a_public_tokenizer(spark, ranks):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {r.doc_id: r.n_tokens for r in token_totals(docs, ["doc_id"], "text", ranks).collect()}
    rows = docs.collect()
    assert found == dict(zip([r.doc_id for r in rows], public([r.text for r in rows])))


@pytest.mark.parametrize("known", [0, 3, 100_000])
def test_lookups_and_joins_agree_on_odd_rows(spark, ranks, known):
    long = "z" * 5000
    rows = [(1, "the cat the cat"), (1, "the cat the cat"), (1, None), (2, ""), (3, None),
            (4, f"{long} the {long}"), (None, "the"), (5, "größer 東京 😀")]
    df = spark.createDataFrame(rows, "k int, text string")
    found = {r.k: (r.n_texts, r.n_tokens) for r in token_totals(df, ["k"], "text", ranks, known).collect()}
    size = public(["the cat the cat", f"{long} the {long}", "the", "größer 東京 😀"])
    assert found == {1: (2, 2 * size[0]), 2: (1, 0), 3: (0, 0), 4: (1, size[1]), None: (1, size[2]),
                     5: (1, size[3])}


def test_empty_table_and_query_without_answers(spark, ranks):
    schema = "task_idx int, query_idx int, answer string"
    none = spark.createDataFrame([], schema)
    assert answer_length_tokens(none, ranks).count() == 0
    found = answer_length_tokens(spark.createDataFrame([(0, 0, None), (0, 1, "a b"), (0, 1, "c")], schema),
                                 ranks).collect()
    assert {r.query_idx: r.answer_length for r in found} == {0: None, 1: 1.5}


def test_file_without_all_bytes_is_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("IQ== 0\n")
    with pytest.raises(ValueError, match="no rank"):
        read_ranks(str(path))

import random

import pytest
from pyspark.sql import functions as F

from variegate.functions import words

TOKENS = [
    ("good muffins cost $3.88 in new york.", "good muffins cost $ 3.88 in new york ."),
    ("please buy me two of them. thanks.", "please buy me two of them . thanks ."),
    ("they'll save and invest more.", "they 'll save and invest more ."),
    ("hi, my name can't hello,", "hi , my name ca n't hello ,"),
    ("i cannot cannot work", "i can not can not work"),
    ('a "quoted" word', "a `` quoted '' word"),
    ("wait... what?! (yes) [no] -- ok", "wait ... what ? ! ( yes ) [ no ] -- ok"),
    ("at 10:30, or 5,000: fine", "at 10:30 , or 5,000 : fine"),
    ("it’s “so” nice", "it ’ s “ so ” nice"),
    ("the dogs' bowl isn't john's", "the dogs ' bowl is n't john 's"),
    ("gimme and gonna gotta lemme wanna go", "gim me and gon na got ta lem me wan na go"),
    ("'tis so", "'t is so"),
    ("uncanny cannots", "uncanny cannots"),
    ("", ""),
    ("  spaced\tout ", "spaced out"),
]


@pytest.mark.parametrize("text, expected", TOKENS)
def test_word_tokens(one, text, expected):
    assert one(words.word_tokens(F.col("t")), t=text) == expected.split()


# The rule of the marks, one alternative for each kind.
MARKS = (r"\.{2,}|--|[;@#$%&?!*\[\](){}<>«“‘„»”’]|`+|[:,](?!\d)"
         r"""|\.(?<=[^.\s]\.)(?=[\])}>"'»”’ ]*(?:\s|\z))""")


def test_marks(spark):
    """One class of signs stands first, and the marks are those of the alternatives."""
    rng = random.Random(3)
    signs = ".-`:,;@#$%&?!*[](){}<>«“‘„»”’‚‛ \n\t1aZé'\""
    texts = [("".join(rng.choices(signs, k=rng.randint(0, 24))),) for _ in range(5000)]
    rows = spark.createDataFrame(texts, "t string")
    marked, expected = (F.regexp_replace("t", rule, " $0 ") for rule in (words.MARKS, MARKS))
    assert rows.where(marked != expected).count() == 0
    assert words.MARKS.startswith("[")


def test_token_count(one):
    assert one(words.token_count(F.col("t")), t="a, b") == 3
    assert one(words.token_count(F.col("t"), words.whitespace_tokens), t="a, b") == 2
    assert one(words.token_count(F.col("t")), t=None) is None


def test_punctuation(one):
    import string

    assert one(words.strip_punctuation(F.col("t")), t=string.punctuation + "aé’") == "aé’"


def test_meaningful(one):
    text = "The dog's 3 big balls, and cannot x1 über"
    assert one(words.meaningful_tokens(F.col("t")), t=text) == ["dogs", "big", "balls", "über"]
    assert one(words.is_meaningful(F.col("t"), 4), t=text)
    assert not one(words.is_meaningful(F.col("t"), 5), t=text)


def test_language():
    with pytest.raises(ValueError, match="Invalid language: chinese"):
        words.stop_words("chinese")


def valid(one, items, reason="stop", **rules):
    column = F.filter(F.split("t", r"\|"), lambda x: x != "")
    return one(words.is_valid_list(column, F.col("r"), **rules), t=items, r=reason)


def test_valid_list(one):
    good, bad = "red paper boat", "it is on"
    assert valid(one, f"{good}|{good}")
    assert not valid(one, f"{good}|{bad}")
    assert valid(one, f"{good}|{bad}", "length")          # the cut-off item does not count
    assert not valid(one, good, "length", min_items=1)
    assert valid(one, f"{good}|{bad}", max_items=1)       # items beyond the cap do not count
    assert valid(one, "")                                 # nothing at all is valid
    assert not valid(one, "", min_items=1)
    assert valid(one, bad, min_tokens=0)

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from variegate.functions import lists

GOLDEN = [
    ("1. **Foo**: bar\n2. baz", ["Foo : bar", "baz"]),
    ("Intro at 10:30 am\n\n1. a\n   cont\n---\n2: b\n3) c", ["30 am", "a cont", "b 3) c"]),
    ("no numbers", []),
    ("1. \n2. foo", ["foo"]),
    ("é1. x\n٣. arabic digit", ["arabic digit"]),
    ("1.a\n2.b", ["a 2.b"]),
    ("1. x y\x1fz\n2. w\r\n3. q", ["x y z", "w", "q"]),
    ("lit<<SPLIT>>5. z", ["z"]),
    ("²1. power", []),
    ("1. one\n\x0b2. tab", ["one", "tab"]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text, items", GOLDEN)
def test_extract_items(one, text, items):
    assert one(lists.extract_items(F.col("t")), t=text) == items


def test_render(one):
    items = F.split("t", ",")
    assert one(lists.render_numbered(items), t="a,b") == "1. a 2. b"
    assert one(lists.render_numbered(items, "\n"), t="a,b") == "1. a\n2. b"


def test_truncated_tail(one):
    items, reason = F.split("t", ","), F.col("r")
    assert one(lists.drop_truncated_tail(items, reason), t="a,b", r="stop") == ["a", "b"]
    assert one(lists.drop_truncated_tail(items, reason), t="a,b", r="length") == ["a"]
    assert one(lists.drop_truncated_tail(items, reason), t="a,b", r=None) == ["a"]
    empty = F.filter(items, lambda x: x == "")
    assert one(lists.drop_truncated_tail(empty, reason), t="a", r="length") == []


def test_strip(one):
    assert one(lists.strip(F.col("t")), t=" \x1c a b\n\t") == "a b"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("abcxyzéß", min_size=1, max_size=6), min_size=1, max_size=4)
                .map(" ".join), min_size=1, max_size=6))
def test_rendered_items_come_back(one, items):
    parsed = lists.extract_items(lists.render_numbered(F.split("t", r"\|"), "\n"))
    assert one(parsed, t="|".join(items)) == items

"""Numbered lists: parse a reply into items, render items as a list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space; Java leaves out the four ASCII separators at \x1c-\x1f.
SPACE = r"[\s\x1c-\x1f]"

# Fixed value: the mark put before an item number while lines are joined.
ITEM_MARK = "<<SPLIT>>"

# The text behind the first number that starts a word and ends in "." or ":".
AFTER_NUMBER = r"(?U)^.*?(?<![\p{L}\p{N}_])\d+[.:]\s*(.*)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def extract_items(text: Column) -> Column:
    """Items of a numbered list; lines without a number are dropped."""
    joined = F.coalesce(text, F.lit(""))
    for pattern, replacement in (
        (rf"(?U)\n{SPACE}+", "\n"),
        ("-{3,}", " "),
        (rf"(?U)\n(\d+[.:]){SPACE}+", ITEM_MARK + "$1"),
        (r"\n|\*+", " "),
        (rf"(?U){SPACE}+", " "),
    ):
        joined = F.regexp_replace(joined, pattern, replacement)
    pieces = F.split(joined, ITEM_MARK)
    items = F.transform(pieces, lambda piece: F.trim(F.regexp_extract(F.trim(piece), AFTER_NUMBER, 1)))
    return F.filter(items, lambda item: item != "")


def render_numbered(items: Column, separator: str = " ") -> Column:
    """``1. a 2. b``"""
    numbered = F.transform(
        items, lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item))
    return F.array_join(numbered, separator)


def head_items(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def drop_truncated_tail(items: Column, finish_reason: Column) -> Column:
    """Without its last item, where the reply did not end by itself."""
    shorter = F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))
    return F.when(finish_reason.eqNullSafe(F.lit("stop")), items).otherwise(shorter)


def evaluated_once(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)``, for functions that use the value in a lambda or more than once.

    As the element of an array the value is made once for each row, and not for each use of it.
    """
    return F.get(F.transform(F.array(value), function), F.lit(0))

"""Byte-pair merging by rank, as model tokenizers with a public merge list count tokens."""

from __future__ import annotations

import base64
import heapq

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published pattern that parts a text into words before bytes are merged.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of byte strings from a file with a base64 string and a rank in each line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} has no rank for the bytes {missing[:5]}")
    return ranks


def words(text: Column, pattern: str = PATTERN) -> Column:
    """The words whose bytes are merged; together they are the text. White space is Unicode's."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def merged(word: bytes, ranks: dict[bytes, int], longest: int) -> list[bytes]:
    """The tokens of a word: of all neighbours those of least rank are joined, the first one of
    equals, until no joined pair has a rank. ``longest`` is the size of the longest ranked string.

    Pairs wait in a heap, so a word of n bytes takes n log n steps.
    """
    size = len(word)
    following, before = list(range(1, size + 1)), list(range(-1, size - 1))
    alive = bytearray(b"\1" * size)
    waiting: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        middle = following[start]
        if middle < size and following[middle] - start <= longest:
            rank = ranks.get(word[start:following[middle]])
            if rank is not None:
                heapq.heappush(waiting, (rank, start, following[middle]))

    for start in range(size - 1):
        offer(start)
    while waiting:
        _, start, end = heapq.heappop(waiting)
        middle = following[start]
        # what has been joined since may have changed either side
        if not alive[start] or middle >= size or following[middle] != end:
            continue
        alive[middle] = 0
        following[start] = end
        if end < size:
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    return [word[i:following[i]] for i in range(size) if alive[i]]

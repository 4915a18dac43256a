"""Pieces of a public vocabulary in a double-array trie, and sums and maxima over segmentations.

Words of equal length are handled together: one array operation takes a step for all of them. Inside
a word a blank is the byte 0xFF, which UTF-8 does not use, so that the marker's own character in a
text stays apart from a blank. Single bytes may always stand for themselves, as byte pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

BLANK = b"\xff"
LONG = 64  # bytes; longer words are handled one by one
WORDS_AT_ONCE = 4096
# Scale for each byte, so that products of probabilities of a word stay within a float's range.
SCALE = 4.0


def alike(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length, and their bytes as a matrix; long words are left out."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for own in np.split(order, cuts):
        if not len(own) or not 0 < sizes[own[0]] <= LONG:
            continue
        for low in range(0, len(own), WORDS_AT_ONCE):
            part = own[low:low + WORDS_AT_ONCE]
            text = b"".join([words[i] for i in part])
            yield part, np.frombuffer(text, np.uint8).reshape(len(part), -1)


def matches(vocabulary: dict, codes: np.ndarray) -> dict[tuple[int, int], tuple]:
    """All pieces in a matrix of words: ``(start, end) -> (rows, pieces)``."""
    base, check, value = (vocabulary[k] for k in ("base", "check", "value"))
    n, length = codes.shape
    flat = codes.ravel().astype(np.int32) + 1
    place, state = np.arange(n * length), np.zeros(n * length, np.int32)
    column = np.tile(np.arange(length), n)
    found = {}
    for size in range(1, length + 1):
        inside = column + size <= length
        place, state, column = place[inside], state[inside], column[inside]
        step = base[state] + flat[place + size - 1]
        goes = check[step] == state
        place, state, column = place[goes], step[goes], column[goes]
        if not len(place):
            break
        piece = value[state]
        hit = piece >= 0
        order = np.argsort(column[hit], kind="stable")
        columns = column[hit][order]
        rows, pieces = place[hit][order] // length, piece[hit][order]
        cuts = np.flatnonzero(np.diff(columns)) + 1
        for own_rows, own_pieces, own in zip(np.split(rows, cuts), np.split(pieces, cuts),
                                             np.split(columns, cuts)):
            if len(own):
                found[int(own[0]), int(own[0]) + size] = (own_rows, own_pieces)
    return found


def best_pieces(vocabulary: dict, words: list[bytes]) -> list[bytes]:
    """Viterbi: for each word the ids of its best segmentation, as bytes of int32.

    The sum of log scores is the largest; of equal ones the shorter last piece is taken.
    """
    out: list[bytes] = [b""] * len(words)
    scores, byte_ids, fallback = (vocabulary[k] for k in ("scores", "byte_ids", "fallback"))
    for places, codes in alike(words):
        n, length = codes.shape
        found = matches(vocabulary, codes)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back = np.ones((length + 1, n), np.int32)
        piece = np.zeros((length + 1, n), np.int32)
        for end in range(1, length + 1):
            best[end] = best[end - 1] + fallback
            piece[end] = byte_ids[codes[:, end - 1]]
            for start in range(end - 1, -1, -1):
                if (start, end) not in found:
                    continue
                rows, pieces = found[start, end]
                score = best[start][rows] + scores[pieces]
                better = score > best[end][rows]
                rows = rows[better]
                best[end][rows] = score[better]
                back[end][rows] = end - start
                piece[end][rows] = pieces[better]
        at, rows = np.full(n, length), np.arange(n)
        steps = np.full((n, length), -1, np.int32)
        column = length
        while (at > 0).any():
            column -= 1
            live = at > 0
            steps[live, column] = piece[at[live], rows[live]]
            at = at - np.where(live, back[at, rows], 0)
        # rows are filled from the right, so dropping the empty places keeps the order
        used = steps >= 0
        ends = np.cumsum(used.sum(1)) * 4
        text = steps[used].tobytes()
        for place, low, high in zip(places.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            out[place] = text[low:high]
    for i, word in enumerate(words):
        if len(word) > LONG:
            out[i] = np.array(_best_of_long(vocabulary, word), np.int32).tobytes()
    return out


def _best_of_long(vocabulary: dict, word: bytes) -> list[int]:
    base, check, value = (vocabulary[k] for k in ("base", "check", "value"))
    scores, byte_ids, fallback = (vocabulary[k] for k in ("scores", "byte_ids", "fallback"))
    best, back, piece = [-math.inf] * (len(word) + 1), [1] * (len(word) + 1), [0] * (len(word) + 1)
    best[0] = 0.0
    # ends are reached from earlier starts first; the shorter piece wins a tie, as above
    for start in range(len(word)):
        score = best[start] + fallback
        if score >= best[start + 1]:
            best[start + 1], back[start + 1] = score, 1
            piece[start + 1] = byte_ids[word[start]]
        state = 0
        for end in range(start + 1, len(word) + 1):
            step = int(base[state]) + word[end - 1] + 1
            if check[step] != state:
                break
            state = step
            if value[state] >= 0:
                score = best[start] + float(scores[value[state]])
                if score >= best[end]:
                    best[end], back[end], piece[end] = score, end - start, int(value[state])
    out, at = [], len(word)
    while at:
        out.append(piece[at])
        at -= back[at]
    return out[::-1]


def log_sums(vocabulary: dict, words: list[bytes], chances: np.ndarray) -> np.ndarray:
    """Forward algorithm: for each word and column of ``chances`` (pieces x languages) the log of
    the sum over all segmentations of the product of the pieces' chances."""
    out = np.zeros((len(words), chances.shape[1]))
    byte_ids = vocabulary["byte_ids"]
    scaled = [chances * math.exp(SCALE * size) for size in range(vocabulary["longest"] + 1)]
    for places, codes in alike(words):
        n, length = codes.shape
        found = matches(vocabulary, codes)
        sums = np.zeros((length + 1, n, chances.shape[1]))
        sums[0] = 1.0
        for end in range(1, length + 1):
            sums[end] = sums[end - 1] * scaled[1][byte_ids[codes[:, end - 1]]]
            for start in range(end - 1, -1, -1):
                if (start, end) in found:
                    rows, pieces = found[start, end]
                    sums[end][rows] += sums[start][rows] * scaled[end - start][pieces]
        out[places] = np.log(np.maximum(sums[length], 1e-300)) - SCALE * length
    for i, word in enumerate(words):
        if len(word) > LONG:
            out[i] = _log_sums_of_long(vocabulary, word, chances)
    return out


def _log_sums_of_long(vocabulary: dict, word: bytes, chances: np.ndarray) -> np.ndarray:
    base, check, value = (vocabulary[k] for k in ("base", "check", "value"))
    logs = np.log(chances)
    sums = np.full((len(word) + 1, chances.shape[1]), -np.inf)
    sums[0] = 0
    for start in range(len(word)):
        byte = vocabulary["byte_ids"][word[start]]
        sums[start + 1] = np.logaddexp(sums[start + 1], sums[start] + logs[byte])
        state = 0
        for end in range(start + 1, len(word) + 1):
            step = int(base[state]) + word[end - 1] + 1
            if check[step] != state:
                break
            state = step
            if value[state] >= 0:
                sums[end] = np.logaddexp(sums[end], sums[start] + logs[value[state]])
    return sums[-1]


def expected_counts(vocabulary: dict, words: list[bytes], weights: np.ndarray,
                    chances: np.ndarray) -> np.ndarray:
    """Forward and backward: how often each piece is expected in the words, by its ``chances``."""
    out = np.zeros(len(chances))
    byte_ids = vocabulary["byte_ids"]
    scaled = [chances * math.exp(SCALE * size) for size in range(vocabulary["longest"] + 1)]
    for places, codes in alike(words):
        n, length = codes.shape
        found = matches(vocabulary, codes)
        ahead, behind = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        ahead[0] = behind[length] = 1.0
        for end in range(1, length + 1):
            ahead[end] = ahead[end - 1] * scaled[1][byte_ids[codes[:, end - 1]]]
            for start in range(end):
                if (start, end) in found:
                    rows, pieces = found[start, end]
                    ahead[end][rows] += ahead[start][rows] * scaled[end - start][pieces]
        for start in range(length - 1, -1, -1):
            behind[start] = behind[start + 1] * scaled[1][byte_ids[codes[:, start]]]
            for end in range(start + 1, length + 1):
                if (start, end) in found:
                    rows, pieces = found[start, end]
                    behind[start][rows] += behind[end][rows] * scaled[end - start][pieces]
        share = weights[places] / np.maximum(ahead[length], 1e-300)
        for (start, end), (rows, pieces) in found.items():
            out += np.bincount(pieces, ahead[start][rows] * scaled[end - start][pieces]
                               * behind[end][rows] * share[rows], len(out))
        for start in range(length):
            pieces = byte_ids[codes[:, start]]
            out += np.bincount(pieces, ahead[start] * scaled[1][pieces] * behind[start + 1]
                               * share, len(out))
    for word, weight in zip(words, weights):
        if len(word) > LONG:
            _expect_in_long(vocabulary, word, weight, chances, out)
    return out


def _expect_in_long(vocabulary: dict, word: bytes, weight: float, chances: np.ndarray,
                    out: np.ndarray) -> None:
    """Add the counts of one word to ``out``, with sums in logs; every piece is met twice."""
    base, check, value = (vocabulary[k] for k in ("base", "check", "value"))
    with np.errstate(divide="ignore"):
        logs = np.log(chances)
    size = len(word)

    def pieces_from(start: int) -> Iterator[tuple[int, int]]:
        yield start + 1, int(vocabulary["byte_ids"][word[start]])
        state = 0
        for end in range(start + 1, size + 1):
            step = int(base[state]) + word[end - 1] + 1
            if check[step] != state:
                return
            state = step
            if value[state] >= 0:
                yield end, int(value[state])

    ahead, behind = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    ahead[0] = behind[size] = 0.0
    for start in range(size):
        for end, piece in pieces_from(start):
            ahead[end] = np.logaddexp(ahead[end], ahead[start] + logs[piece])
    for start in range(size - 1, -1, -1):
        for end, piece in pieces_from(start):
            behind[start] = np.logaddexp(behind[start], behind[end] + logs[piece])
            out[piece] += weight * math.exp(ahead[start] + logs[piece] + behind[end] - ahead[size])

"""The public vocabulary in a double-array trie. Only the driver uses this module."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from variegate.llm.lattice import BLANK

MARKER = "▁"  # a blank, as the vocabulary writes it


@lru_cache(maxsize=2)
def read_vocabulary(path: str) -> dict:
    """Pieces, byte pieces and log scores of a SentencePiece model with byte fallback.

    The scores of a merge list are ranks, so the log score of a piece is taken by Zipf's law
    from its rank: ``-ln(rank + 10)``, less the log of the sum. A byte that stands for itself
    costs 10 more than the rarest piece. Read on the driver; the result holds arrays of a
    size set by the vocabulary.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, byte_ids = [], np.full(256, -1, np.int32)
    keys: dict[bytes, int] = {}
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[1:-1], 16)] = i
            names.append(bytes([int(name[1:-1], 16)]))
            continue
        names.append(name.replace(MARKER, " ").encode())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            keys[name.encode().replace(MARKER.encode(), BLANK)] = i
    if (byte_ids < 0).any():
        raise ValueError(f"{path} has no piece for every byte")
    for key in keys:
        if BLANK in key.lstrip(BLANK) or (b"\n" in key and key != b"\n"):
            raise ValueError(f"piece {key!r} reaches across words")
    scores = np.full(len(names), -np.inf)
    ranked = sorted(keys.values(), key=lambda i: (-model.get_score(i), i))
    scores[ranked] = -np.log(np.arange(len(ranked)) + 10.0)
    scores -= np.log(np.exp(scores).sum())
    base, check, value = double_array(keys)
    return {"base": base, "check": check, "value": value, "scores": scores, "names": names,
            "byte_ids": byte_ids, "fallback": float(scores[ranked].min()) - 10.0,
            "longest": max(map(len, keys))}


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, check, value``: byte ``c`` leads from node ``s`` to ``t = base[s] + c + 1`` if
    ``check[t] == s``; ``value[t]`` is the piece that ends there or -1. Node 0 is the root."""
    names = sorted(keys)
    room = 512
    base, check, value = [0] * room, [-1] * room, [-1] * room
    check[0] = 0
    waiting = [(0, 0, len(names), 0)]
    first = {True: 1, False: 1}  # where to look for room, for one child and for several
    while waiting:
        node, low, high, depth = waiting.pop()
        if low < high and len(names[low]) == depth:
            value[node] = keys[names[low]]
            low += 1
        children = []
        while low < high:
            byte, end = names[low][depth], low
            while end < high and names[end][depth] == byte:
                end += 1
            children.append((byte + 1, low, end))
            low = end
        if not children:
            continue
        alone = len(children) == 1
        at = first[alone]
        while True:
            while at < len(check) and check[at] != -1:
                at += 1
            start = at - children[0][0]
            need = max(start, 0) + 258
            if need > len(check):
                grow = max(need, 2 * len(check)) - len(check)
                base += [0] * grow
                check += [-1] * grow
                value += [-1] * grow
            if start >= 0 and all(check[start + c] == -1 for c, _, _ in children):
                break
            at += 1
        if alone or at > first[alone] + 256:
            first[alone] = at
        base[node] = start
        for code, begin, end in children:
            check[start + code] = node
            waiting.append((start + code, begin, end, depth + 1))
    pad = [0] * 258
    return (np.array(base + pad, np.int32), np.array(check + [-1] * 258, np.int32),
            np.array(value + [-1] * 258, np.int32))

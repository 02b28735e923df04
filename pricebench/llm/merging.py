"""Byte-pair merging, shared by the tokenizer operators."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

#: Bits of a part's number; vocabularies are far smaller.
_BITS = 21


def pair_table(tokens: dict[bytes, int]) -> dict[int, int]:
    """For vocabularies whose ids are ranks: two parts' ids, packed, to the id they merge into."""
    out = {}
    for token, i in tokens.items():
        for cut in range(1, len(token)):
            a, b = tokens.get(token[:cut]), tokens.get(token[cut:])
            if a is not None and b is not None:
                out[a << _BITS | b] = i
    return out


def pack_pair(a: int, b: int) -> int:
    return a << _BITS | b


def merge(parts: list[int], pairs: dict[int, int]) -> list[int]:
    """Merges neighbouring parts, always the pair of lowest rank, leftmost first.

    ``pairs`` maps a packed pair to its rank, which is also the number of the
    merged part.  Parts are linked to their neighbours; heap entries are rank and
    position in one number.  An entry that a later merge has overtaken no longer
    equals the rank noted at its position and is skipped.  O(n log n) for n parts.
    """
    n = len(parts)
    get = pairs.get
    noted = [get(a << _BITS | b, -1) for a, b in zip(parts, parts[1:])]
    noted.append(-1)
    heap = [r * n + i for i, r in enumerate(noted) if r >= 0]
    if not heap:
        return parts
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        rank, i = divmod(heappop(heap), n)
        if noted[i] != rank:
            continue
        j = after[i]
        parts[i] = rank
        parts[j] = noted[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            noted[i] = r = get(rank << _BITS | parts[k], -1)
            if r >= 0:
                heappush(heap, r * n + i)
        else:
            noted[i] = -1
        h = before[i]
        if h >= 0:
            noted[h] = r = get(parts[h] << _BITS | rank, -1)
            if r >= 0:
                heappush(heap, r * n + h)
    return [p for p in parts if p >= 0]

"""Minimal perfect hash over a fixed set of byte strings (hash and displace).

Keys are dealt to buckets by one half of their 64-bit hash.  Starting with the
fullest bucket, a displacement is searched that sends all keys of the bucket to
free slots.  The table has exactly one slot per key, so a lookup costs one hash,
one displacement and one comparison with the stored key.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * _MIX & _MASK)) * 0xD6E8FEB86659FD93 & _MASK
    return (x ^ x >> 32) % n


class PerfectHash:
    """Maps each key to its value; other strings to None."""

    def __init__(self, values: dict[bytes, int], per_bucket: int = 4):
        n = len(values)
        self.n, self.n_buckets = n, max(1, -(-n // per_bucket))
        self.shift = np.zeros(self.n_buckets, np.uint32)
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        hashes = {k: xxhash.xxh3_64_intdigest(k) for k in values}
        buckets: list[list[bytes]] = [[] for _ in range(self.n_buckets)]
        for k, h in hashes.items():
            buckets[(h >> 32) % self.n_buckets].append(k)
        free = np.ones(n, bool)
        for b in sorted(range(self.n_buckets), key=lambda i: -len(buckets[i])):
            if not buckets[b]:
                continue
            hs = np.array([hashes[k] for k in buckets[b]], np.uint64)
            at, d = self._search(hs, free, n)
            self.shift[b] = d
            free[at] = False
            for k, slot in zip(buckets[b], at.tolist()):
                self.keys[slot], self.values[slot] = k, values[k]
        self.shift = self.shift.tolist()  # single look-ups are faster in a list

    @staticmethod
    def _search(hs: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, int]:
        """The first displacement under which all hashes meet free, different slots."""
        lo, step = 0, 64
        while True:
            d = np.arange(lo, lo + step, dtype=np.uint64)[:, None]
            with np.errstate(over="ignore"):
                x = (hs[None, :] ^ (d * np.uint64(_MIX))) * np.uint64(0xD6E8FEB86659FD93)
            slots = ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)
            good = free[slots].all(1)
            if len(hs) > 1:
                s = np.sort(slots, 1)
                good &= (s[:, 1:] != s[:, :-1]).all(1)
            if good.any():
                i = int(good.argmax())
                return slots[i], lo + i
            lo, step = lo + step, min(step * 2, 65536)

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        slot = _slot(h, self.shift[(h >> 32) % self.n_buckets], self.n)
        return self.values[slot] if self.keys[slot] == key else None

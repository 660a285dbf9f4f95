"""Vectorised polynomial hashes of substrings, modulo 2^64, over buffers of many texts."""
from __future__ import annotations

import numpy as np

_U = np.uint64
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> _U(30))
    h = h * _MIX1
    h ^= h >> _U(27)
    h *= _MIX2
    h ^= h >> _U(31)
    return h


class Substrings:
    """Hashes of substrings of one buffer in constant time each."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        base = int(mix(np.array([seed * 2 + 1], dtype=np.uint64))[0]) | 1
        n = len(data)
        have = self._powers.get(seed)
        if have is None or len(have[0]) <= n:
            size = max(n + 1, 1 << 20)
            up = np.full(size, base, dtype=np.uint64)
            up[0] = 1
            down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
            down[0] = 1
            have = self._powers[seed] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        table = mix(np.arange(256, dtype=np.uint64) + _U(seed << 8))
        self.up = have[0]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[data] * have[1][:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, end) for arrays of positions; the length takes part."""
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))


def buffers(rows, limit: int = 4_000_000):
    """Groups of (key, bytes) rows whose bytes add up to about ``limit``."""
    held, size = [], 0
    for key, raw in rows:
        held.append((key, raw))
        size += len(raw)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held

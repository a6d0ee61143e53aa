"""Vectorised word and shingle hashes of whole texts."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15
_PLACE = [U(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U(30))) * _MIX[0]
    h = (h ^ (h >> U(27))) * _MIX[1]
    return h ^ (h >> U(31))


class Hasher:
    """Polynomial hashes of words modulo 2**64 over random byte values, finalised; ``lower`` folds A-Z."""

    def __init__(self, lower: bool = True, chunk: int = 1 << 16):
        rng = np.random.default_rng(20240229)
        values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.values = values[fold]
        self.blank = np.zeros(256, bool)
        self.blank[list(_BLANKS)] = True
        self.grow(chunk)

    def grow(self, n: int) -> None:
        up, down = U(_BASE), U(pow(_BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(n, up)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(n, down)]), dtype=np.uint64)
        self.size = n

    def words(self, data: bytes) -> np.ndarray:
        """Hashes of the words of a UTF-8 text, in order."""
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return np.zeros(0, np.uint64)
        if len(b) > self.size:
            self.grow(2 * len(b))
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~self.blank[b]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(self.values[b] * self.up[: len(b)], out=sums[1:])
            return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def shingles(self, data: bytes, width: int = 5) -> np.ndarray:
        """Sorted distinct shingle hashes; a text of fewer words is one shingle; no words, none."""
        h = self.words(data)
        if not len(h):
            return h
        with np.errstate(over="ignore"):
            if len(h) < width:
                total = U(len(h))
                for place, x in zip(_PLACE, h):
                    total = total + place * x
                return mix(np.array([total], np.uint64))
            n = len(h) - width + 1
            total = np.full(n, U(width))
            for k in range(width):
                total += h[k : k + n] * _PLACE[k]
            return np.unique(mix(total))

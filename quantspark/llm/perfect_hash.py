"""A minimal perfect hash of 64-bit keys, in numpy.

Level by level, each key that is left takes a cell of a bit array; cells that
two keys want stay clear and their keys go on to the next level. The number of
a key is the count of set bits before its own.
"""

from __future__ import annotations

import io

import numpy as np

from .kernels import mix

GAMMA, LEVELS = 1.5, 64


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], cells: list[int]):
        """levels: 64-bit words of the bit arrays; cells: how many bits of each are in use."""
        self.levels, self.cells = levels, cells
        self.before, n = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())
        self.n = n

    @staticmethod
    def _cell(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
        return (mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(cells)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: different uint64."""
        levels, sizes, left = [], [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys repeat")
            cells = int(len(left) * GAMMA) + 64
            at = cls._cell(left, len(levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            words = np.packbits(alone, bitorder="little")
            levels.append(np.frombuffer(words.tobytes() + bytes(-len(words) % 8), np.uint64))
            sizes.append(cells)
            left = left[~alone[at]]
        return cls(levels, sizes)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """0..n-1 for keys it was built of; for others -1 or any number."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, cells, before) in enumerate(zip(self.levels, self.cells, self.before, strict=True)):
            at = self._cell(keys[left], level, cells)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = before[at[hit] >> 6] + below[hit]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, cells=np.array(self.cells, np.int64), **{f"w{i}": w for i, w in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        got = np.load(io.BytesIO(raw))
        cells = got["cells"].tolist()
        return cls([got[f"w{i}"] for i in range(len(cells))], cells)

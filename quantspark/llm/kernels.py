"""Vectorised byte and word kernels shared by the operators.

A batch of texts is one UTF-8 byte array with a boundary per document, so a
kernel costs a handful of numpy passes per byte, not Python work per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_MUL1, _MUL2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: [\x20\x09-\x0D]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the rounds, the mask of the first n bytes of a block, and the most bytes hashed by rounds.
_ROUND1, _ROUND2, _ROUND3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x85EBCA77C2B2AE63)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
LONG = 64
_powers: dict[int, np.ndarray] = {}
#: The longest table of powers that a worker keeps.
KEPT_POWERS = 8 << 20
#: Bytes of text that a kernel handles at once.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= _MUL1
    x ^= x >> U64(27)
    x *= _MUL2
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for next time unless a very long text asks."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(1, U64)
        while len(out) < n:
            out = np.concatenate([out, out * U64(pow(base, len(out), 2**64))])
        if n <= KEPT_POWERS:
            _powers[base] = out
        have = out
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    n = len(column)
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES):
    """Slices (first, last, bytes, offsets) of about `most` bytes; a longer text is a slice of its own."""
    raw, off = text_bytes(column)
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, last, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[raw]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a chunk: start and end byte, a 64-bit hash each, and the documents' word offsets."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE, hashed: bool = True):
        gap = space[raw]
        edge = np.ones(len(raw) + 1, bool)
        if len(raw):
            edge[1:-1] = gap[:-1]
            edge[off[:-1][off[:-1] < len(raw)]] = True  # a document begins a word
        edge = edge[:-1]
        self.start = np.flatnonzero(edge & ~gap)
        stop = np.ones(len(raw), bool)
        if len(raw):
            stop[:-1] = gap[1:]
            stop[off[1:][off[1:] > 0] - 1] = True
        self.end = np.flatnonzero(stop & ~gap) + 1
        self.off = np.searchsorted(self.start, off)
        self.hash = words_hash(raw, self.start, self.end) if hashed else None


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def words_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each pair: multiply-and-rotate rounds over blocks of eight bytes, in the manner of
    xxh64, so no sum over places can cancel; spans over LONG bytes by xxh3."""
    size = end - start
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(raw) + 1, np.uint64, padded.data, strides=(1,))  # the eight bytes from each place
    h = size.astype(U64) * _ROUND3
    here, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(here):
        left = size[here] - at
        x = blocks[start[here] + at] & _FIRST_BYTES[np.minimum(left, 8)]
        x = _turned(x * _ROUND2, 31) * _ROUND1
        h[here] = _turned(h[here] ^ x, 27) * _ROUND1 + _ROUND3
        at += 8
        here = here[left > 8]
    far = np.flatnonzero(size > LONG)
    if len(far):
        data = raw.data
        h[far] = [xxhash.xxh3_64_intdigest(data[a:z]) for a, z in zip(start[far].tolist(), end[far].tolist(), strict=True)]
    return mix(h)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running polynomial sums; the difference of two, scaled, hashes the bytes between.

    Modulo 2**64 such sums can agree for different strings, by design of the strings: they find candidates and deal rows,
    and never decide that two texts are equal."""
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(_TABLE[raw] * powers(_BASE, len(raw)), out=out[1:])
    return out


_INV = pow(_BASE, -1, 2**64)


def spans_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each pair."""
    sums = prefix_hash(raw) if sums is None else sums
    h = (sums[end] - sums[start]) * powers(_INV, len(raw) + 1)[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def every_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """`spans_hash` of the `size` bytes from each start, by slices of the running sums."""
    n = len(sums) - size
    h = sums[size:] - sums[:n]
    h *= powers(_INV, n)
    h += U64(size * 0xD6E8FEB86659FD93 % 2**64)
    return mix(h)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k consecutive words, one for every start (the last k-1 starts left out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(0x2545F4914F6CDD1D + seed), U64)
    for i in range(k):
        out *= U64(0x9FB21C651E98DF25)
        out += h[i : i + n] ^ (out >> U64(32))
    return mix(out)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Of each w consecutive values the index of the least by its leading 32 bits, the leftmost of equals.

    The index rides in the low bits, so the sliding minimum is a few passes of np.minimum. Equal windows choose the same
    place, as the choice depends on nothing outside the window.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64), 1
    while span * 2 <= w:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < w:
        best = np.minimum(best[:n], best[w - span : w - span + n])
    return (best[:n] & U64(0xFFFFFFFF)).astype(np.int64)

"""External induced suffix sorting that carries suffix tuples and common-prefix values.

A suffix is S (less than the next one) or L (greater); sorted leftmost-S
suffixes induce all L suffixes in one sweep, which induce all S suffixes in a
sweep back. The leftmost-S suffixes themselves are sorted by recursion on the
names of the substrings between them.

A sweep is a priority queue by (first symbol, order of arrival). What it holds
are tuples: the suffix's start, a word of the symbols before it, the length of
the run that it begins with, and the length of the prefix that it shares with
the tuple before. A popped tuple makes the tuple of the suffix before it from
its own word; the text (words of several symbols) is read only where a word is
used up. Types follow from symbols: the suffix before is L if its symbol is not
less, and S if it is less or goes on a run of an S suffix.

Common prefixes are induced with the suffixes: two suffixes that follow each
other in a bucket share one symbol more than the tuples that made them, and
those share the least of the values popped between them. At the seam of a
bucket's L and S suffixes it is the shorter of the two runs. Names of equal
substrings come from the same values: leftmost-S substrings that reach their
ends together, and go on with runs of one length, agree without bound. The
values of the recursion are carried back through the substrings' lengths.

As every symbol's count is known, a symbol's tuples have a fixed range of slots.
Slots are popped in blocks: a block ends before the first slot that one of its
own tuples is pushed to, so popping in blocks and popping one by one give the
same order. The recursion ends with names that memory holds several times over:
they are sorted directly. Text words, slots and the lists between recursions are files in the
task's own temporary folder when they have more than `in_memory` entries; what
stays in memory is a block, and a few numbers for each symbol. Files end with
the call; a retried task makes them anew.
"""

from __future__ import annotations

import tempfile
from contextlib import ExitStack

import numpy as np

#: Entries of an array that is kept in memory, and of a block; a common prefix without bound; names are sorted directly where
#: they are so many times fewer than memory holds.
IN_MEMORY, BLOCK, BIG, DIRECT = 1 << 22, 1 << 16, 1 << 30, 4
_PART = 1 << 20


class _Files:
    """Arrays in memory up to a size, then in files."""

    def __init__(self, held: ExitStack, in_memory: int):
        self.held, self.in_memory, self.on_disk = held, in_memory, 0

    def array(self, n: int, dtype, fill: int | None = None) -> np.ndarray:
        if n <= self.in_memory:
            out = np.empty(n, dtype)
        else:
            self.on_disk += 1
            out = np.memmap(self.held.enter_context(tempfile.TemporaryFile(prefix="suffixes")), dtype, "w+", shape=(n,))
        if fill is not None:
            out[:] = fill
        return out


class _Text:
    """A text as words of a power of two of symbols; the last symbol is 0 and occurs nowhere else."""

    def __init__(self, t: np.ndarray, symbols: int, files: _Files):
        self.n, self.symbols = len(t), symbols
        self.bits = max(1, (symbols - 1).bit_length())
        self.shift = (64 // self.bits).bit_length() - 1
        k = 1 << self.shift
        self.mask = np.uint64((1 << self.bits) - 1)
        self.words = files.array(-(-self.n >> self.shift), np.uint64)
        self.counts = np.zeros(symbols, np.int64)
        places = (np.arange(k) * self.bits).astype(np.uint64)
        step = _PART << self.shift
        for a in range(0, self.n, step):
            part = np.asarray(t[a : a + step]).astype(np.uint64)
            self.counts += np.bincount(part.astype(np.int64), minlength=symbols)
            part = np.append(part, np.zeros(-len(part) % k, np.uint64)).reshape(-1, k)
            self.words[a >> self.shift : (a >> self.shift) + len(part)] = np.bitwise_or.reduce(part << places, axis=1)

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> self.shift]

    def symbol(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((word >> ((at & ((1 << self.shift) - 1)) * self.bits).astype(np.uint64)) & self.mask).astype(np.int64)


def _leftmost(t: np.ndarray, files: _Files) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths of their runs) of the leftmost-S suffixes: runs less than both their neighbours, and the last symbol."""
    n, found, runs = len(t), files.array(len(t) // 2 + 1, np.int64), files.array(len(t) // 2 + 1, np.int32)
    k, at, before = 0, 0, -1  # `at` begins a run; `before` is the symbol of the run before it
    while at < n - 1:
        size = _PART
        while True:  # at least one whole run and the symbol after it
            part = np.asarray(t[at : at + size]).astype(np.int64)
            starts = np.append(0, np.flatnonzero(part[1:] != part[:-1]) + 1)
            if len(starts) > 1:
                break
            size *= 2
        symbols = part[starts]
        low = (np.append(before, symbols[:-2]) > symbols[:-1]) & (symbols[1:] > symbols[:-1])
        here = np.flatnonzero(low)
        found[k : k + len(here)], runs[k : k + len(here)] = starts[here] + at, starts[here + 1] - starts[here]
        k, before, at = k + len(here), int(symbols[-2]), at + int(starts[-1])
    found[k], runs[k] = n - 1, 1
    return found[: k + 1], runs[: k + 1]


class _Least:
    """The least of the values popped since each channel's last event. Values come in blocks; of the blocks before, only those
    less than all after them are kept, in a stack."""

    def __init__(self, channels: int):
        self.block_of, self.low = np.full(channels, -1, np.int64), np.full(channels, BIG, np.int64)
        self.blocks: list[int] = []
        self.least: list[int] = []
        self.no = 0

    def load(self, values: np.ndarray) -> None:
        self.tables = [values]
        self.after = np.append(np.minimum.accumulate(values[::-1])[::-1], BIG)

    def _between(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The least of values[a..z], both included."""
        size = z - a + 1
        level = np.frexp(size)[1] - 1
        while len(self.tables) <= level.max(initial=0):
            t, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(t[:-half], t[half:]))
        if level.max(initial=0) < 1:
            return self.tables[0][a]
        out = np.empty(len(a), np.int64)
        for v in range(int(level.max()) + 1):
            own = np.flatnonzero(level == v)
            if len(own):
                t = self.tables[v]
                out[own] = np.minimum(t[a[own]], t[z[own] - (1 << v) + 1])
        return out

    def since(self, channel: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For events in order of (channel, at): the least value after the channel's event before, up to and with `at`; -1 for a
        channel's first event."""
        new = np.ones(len(at), bool)
        new[1:] = channel[1:] != channel[:-1]
        begin = np.zeros(len(at), np.int64)
        begin[1:][~new[1:]] = at[:-1][~new[1:]] + 1
        out = self._between(begin, at)
        heads = np.flatnonzero(new)
        own = channel[heads]
        then = self.block_of[own]
        least = np.append(np.array(self.least, np.int64), BIG)[np.searchsorted(np.array(self.blocks, np.int64), then + 1)]
        out[heads] = np.where(then < 0, -1, np.minimum(out[heads], np.minimum(self.low[own], least)))
        last = np.append(heads[1:], len(at)) - 1
        self.block_of[own], self.low[own] = self.no, self.after[at[last] + 1]
        return out

    def close(self) -> None:
        value = int(self.after[0])
        while self.least and self.least[-1] >= value:
            self.least.pop()
            self.blocks.pop()
        self.least.append(value)
        self.blocks.append(self.no)
        self.no += 1


class _Slots:
    """The tuples of a sweep, or the same read from the last to the first."""

    def __init__(self, start: np.ndarray, word: np.ndarray, run: np.ndarray, lcp: np.ndarray):
        self.start, self.word, self.run, self.lcp = start, word, run, lcp

    def back(self) -> _Slots:
        return _Slots(self.start[::-1], self.word[::-1], self.run[::-1], self.lcp[::-1])


def _sweep(q: _Slots, text: _Text, head: np.ndarray, edges: np.ndarray, back: bool, mine: np.ndarray, seam: np.ndarray, leftmost: list | None) -> None:
    """Pops the slots from first to last and pushes what they induce.

    head: each symbol's next free slot; edges: where the buckets begin, in order of popping, and the end; mine: by bucket, the
    end of the slots that this sweep fills; seam: by bucket, its first slot that was filled before, or -1. leftmost: if given,
    takes (starts, common prefixes with the one before) of the leftmost-S suffixes that are popped.
    """
    n, buckets = len(q.start), len(edges) - 1
    began = edges[:-1]
    seams = np.sort(seam[seam >= 0])
    least, found = _Least(text.symbols), _Least(1)
    at, size = 0, 1024
    while at < n:
        end = min(n, at + size)
        for_seam = seams[np.searchsorted(seams, at) : np.searchsorted(seams, end)]
        if len(for_seam):
            bucket = np.searchsorted(edges, for_seam, "right") - 1
            symbol = buckets - 1 - bucket if back else bucket
            filled = head[symbol] - 1
            other = np.minimum(q.run[np.maximum(filled, 0)], q.run[for_seam])
            q.lcp[for_seam] = np.where(filled >= began[bucket], other, 0)
        start = np.asarray(q.start[at:end])
        source = np.flatnonzero(start > 0)
        before = start[source].astype(np.int64) - 1
        bucket = np.searchsorted(edges, source + at, "right") - 1
        own = buckets - 1 - bucket if back else bucket
        word = q.word[at:end][source]
        symbol = text.symbol(word, before)
        low = None
        if back:
            filled = source + at < mine[bucket]
            ok = (symbol < own) | (symbol == own) & filled
            if leftmost is not None:
                low = source[filled & (symbol > own)]
        else:
            ok = symbol >= own
        source, before, symbol, own, word = source[ok], before[ok], symbol[ok], own[ok], word[ok]
        moved, grown = end - at, min(size * 2, BLOCK)
        if len(source):
            order = np.argsort(symbol.astype(np.uint16) if buckets <= 1 << 16 else symbol, kind="stable")  # 16 bits are sorted by radix
            ranked, place = symbol[order], np.arange(len(symbol))
            first = np.where(np.append(True, ranked[1:] != ranked[:-1]), place, 0)
            target = np.empty(len(symbol), np.int64)
            target[order] = head[ranked] + place - np.maximum.accumulate(first)
            nearest = np.minimum.accumulate(target) - at
            late = nearest[:-1] <= source[1:]
            k = int(late.argmax()) + 1 if late.any() else len(source)
            moved = min(moved, int(nearest[k - 1]))
            grown = grown if moved == end - at else max(64, 2 * moved)
            order = order[order < k] if k < len(source) else order
        least.load(np.asarray(q.lcp[at : at + moved]).astype(np.int64))
        if len(source):
            value = least.since(symbol[order], source[order])
            to, made, was = target[order], before[order], symbol[order]
            renewed = word[order]
            used = np.flatnonzero((made & ((1 << text.shift) - 1) == 0) & (made > 0))
            renewed[used] = text.word(made[used] - 1)
            q.start[to], q.word[to], q.lcp[to] = made, renewed, value + 1
            q.run[to] = np.where(was == own[order], q.run[at:end][source[order]] + 1, 1)
            head[was] = to + 1  # a symbol's last target counts, and its targets ascend
        if low is not None:
            found.load(least.tables[0])
            low = low[low < moved]
            if len(low):
                leftmost.append((start[low].astype(np.int64), found.since(np.zeros(len(low), np.int64), low)))
            found.close()
        least.close()
        at, size = at + moved, grown


def _seeded(q: _Slots, text: _Text, seeds: tuple[np.ndarray, np.ndarray, np.ndarray | None]) -> np.ndarray:
    """Puts seeds (start, run, common prefix) at the ends of their buckets, in their order; returns how many each symbol has.

    Without common prefixes seeds are not in order yet: then longer runs go first, as such suffixes are less, and seeds of
    equal runs agree without bound.
    """
    starts, runs, lcps = seeds

    def part(a: int):
        start, run = np.asarray(starts[a : a + _PART]), np.asarray(runs[a : a + _PART])
        symbol = text.symbol(text.word(start), start)
        return start, run, symbol << 32 | (0 if lcps is not None else BIG - run.astype(np.int64))

    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(starts), _PART):
        new, m = np.unique(part(a)[2], return_counts=True)
        both, back = np.unique(np.append(keys, new), return_inverse=True)
        keys, n = both, np.bincount(back, np.append(n, m)).astype(np.int64)
    held = np.bincount(keys >> 32, n, text.symbols).astype(np.int64)
    before = np.cumsum(n) - n  # seeds of lesser keys
    first = np.cumsum(text.counts)[keys >> 32] - held[keys >> 32] + before - (np.cumsum(held) - held)[keys >> 32]
    to = first.copy()
    for a in range(0, len(starts), _PART):
        start, run, key = part(a)
        key = np.searchsorted(keys, key)
        order = np.argsort(key, kind="stable")
        ranked, place = key[order], np.arange(len(key))
        slot = to[ranked] + place - np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1]), place, 0))
        to[ranked] = slot + 1
        start, run = start[order], run[order]
        q.start[slot], q.run[slot], q.word[slot] = start, run, text.word(np.maximum(start - 1, 0))
        q.lcp[slot] = np.where(slot == first[ranked], run, BIG) if lcps is None else np.asarray(lcps[a : a + _PART])[order]
    return held


def _induce(text: _Text, seeds: tuple[np.ndarray, np.ndarray, np.ndarray | None], files: _Files, leftmost: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, common prefixes with the suffix before) of all suffixes, as seeds (start, run, common prefix) induce them."""
    n, narrow, step = text.n, np.int32 if text.n < 2**31 - 1 else np.int64, _PART
    q = _Slots(files.array(n, narrow, -1), files.array(n, np.uint64), files.array(n, np.int32), files.array(n, np.int32, BIG))
    ends = np.cumsum(text.counts)
    begins = ends - text.counts
    held = _seeded(q, text, seeds)
    head = begins.copy()
    edges = np.append(begins, n)
    _sweep(q, text, head, edges, False, ends, np.where(held > 0, ends - held, -1), None)
    # what was induced stays; its values become those with the tuple after, as the sweep back meets them
    induced = head - begins
    for a in range(0, n, step):
        z = min(n, a + step)
        bucket = np.repeat(np.arange(text.symbols), np.clip(ends, a, z) - np.clip(begins, a, z))
        keep = np.arange(a, z) < head[bucket]
        following = np.append(np.asarray(q.lcp[a + 1 : z + 1]), 0)[: z - a]
        q.lcp[a:z] = np.where(keep, following, BIG)
        q.start[a:z] = np.where(keep, q.start[a:z], -1)
    r = q.back()
    first = n - head  # of each symbol's slots from the back, the first that is kept
    _sweep(r, text, n - ends, np.append((n - ends)[::-1], n), True, first[::-1], np.where(induced > 0, first, -1), leftmost)
    q.start[0] = n - 1
    if leftmost is not None:
        return q.start, q.lcp
    for z in range(n, 0, -step):  # back to the values with the suffix before
        a = max(0, z - step)
        q.lcp[max(a, 1) : z] = q.lcp[max(a, 1) - 1 : z - 1].copy()
    q.lcp[0] = 0
    q.lcp[begins[text.counts > 0]] = 0
    return q.start, q.lcp


def _names(starts: np.ndarray, prefixes: np.ndarray, n: int, files: _Files) -> tuple[np.ndarray, np.ndarray]:
    """(names in text order, common prefixes of a name and the one before), for leftmost-S substrings in ascending order;
    equal ones have a common prefix without bound."""
    new = prefixes < BIG
    new[:1] = True
    by_half = files.array(n // 2 + 1, np.int32 if n < 2**31 else np.int64, -1)  # no two of them are neighbours
    name = np.cumsum(new) - 1
    by_half[starts >> 1] = name
    out, k = files.array(len(starts), by_half.dtype), 0
    for a in range(0, len(by_half), _PART):
        part = np.asarray(by_half[a : a + _PART])
        part = part[part >= 0]
        out[k : k + len(part)] = part
        k += len(part)
    return out, prefixes[new]


def _range_least(values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The least of values[a..z-1] for each pair, by a tree of minima."""
    size = 1 << max(0, (len(values) - 1).bit_length())
    tree = np.full(2 * size, BIG, np.int64)
    tree[size : size + len(values)] = values
    for level in range(size.bit_length() - 2, -1, -1):
        a0 = 1 << level
        tree[a0 : 2 * a0] = np.minimum(tree[2 * a0 : 4 * a0 : 2], tree[2 * a0 + 1 : 4 * a0 : 2])
    out, a, z = np.full(len(a), BIG, np.int64), a + size, z + size
    while (a < z).any():
        odd = (a < z) & (a & 1 == 1)
        out[odd] = np.minimum(out[odd], tree[a[odd]])
        a = a + odd
        odd = (a < z) & (z & 1 == 1)
        z = z - odd
        out[odd] = np.minimum(out[odd], tree[z[odd]])
        a, z = a >> 1, z >> 1
    return out


def _doubled(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts in order, common prefixes with the one before) by doubling: ranks of 1, 2, 4.. symbols until none are equal. For
    names that memory holds several times over."""
    n, ranks, size = len(t), [np.asarray(t).astype(np.int64)], 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - size, 0)] = ranks[-1][size:] + 1
        different, rank = np.unique(ranks[-1] << 32 | after, return_inverse=True)
        if len(different) == n:
            break
        ranks.append(rank)
        size *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, z = order[:-1].copy(), order[1:].copy()
    for held in reversed(ranks):
        held = np.append(held, [-1] * (size + 1))  # past the end nothing is equal, as the last symbol is alone
        same = np.flatnonzero(held[a] == held[z])
        a[same] += size
        z[same] += size
        size //= 2
    return order, np.append(0, a - order[:-1])


def suffix_array(t: np.ndarray, symbols: int, in_memory: int | None = None, held: ExitStack | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all suffixes in order, common prefix of each with the one before). t: integers under `symbols`; the last is
    0 and occurs nowhere else. Arrays of more than in_memory entries are files; give `held` to keep the result's open."""
    if held is None:
        with ExitStack() as own:
            return tuple(np.array(x) for x in suffix_array(t, symbols, in_memory, own))
    files = _Files(held, IN_MEMORY if in_memory is None else in_memory)
    if len(t) == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    with ExitStack() as inner:
        own = _Files(inner, files.in_memory)
        text = _Text(t, symbols, own)
        starts, runs = _leftmost(t, own)
        popped: list[tuple[np.ndarray, np.ndarray]] = []
        with ExitStack() as first:
            _induce(text, (starts, runs, None), _Files(first, files.in_memory), popped)
        # from the greatest to the least; the last symbol, the least of all, is not popped
        ordered = np.concatenate([np.zeros(0, np.int64), *(s for s, _ in popped)])[::-1]
        shared = np.concatenate([np.zeros(0, np.int64), *(v for _, v in popped)])[::-1]
        ordered, prefixes = np.append(len(t) - 1, ordered), np.concatenate([[0, 0], shared[:-1]])[: len(ordered) + 1]
        if (prefixes >= BIG).any():
            names, between = _names(ordered, prefixes, len(t), own)
            if len(names) <= files.in_memory // DIRECT:
                order, same = _doubled(names)
            else:
                order, same = suffix_array(names, len(between), files.in_memory, inner)
            ordered, prefixes = np.empty(len(order), np.int64), np.zeros(len(order), np.int64)
            for a in range(0, len(order), _PART):
                here = np.asarray(order[a : a + _PART]).astype(np.int64)
                past = np.asarray(order[max(a - 1, 0) : a + len(here) - 1]).astype(np.int64)
                ordered[a : a + len(here)] = starts[here]
                some = here if a else here[1:]
                m = np.asarray(same[a : a + len(here)])[len(here) - len(some) :].astype(np.int64)
                agree = _range_least(between, names[past + m].astype(np.int64) + 1, names[some + m].astype(np.int64) + 1)
                prefixes[a + len(here) - len(some) : a + len(here)] = starts[some + m] - starts[some] + agree
        run = runs[np.searchsorted(starts, ordered)]
        return _induce(text, (ordered, run, np.minimum(prefixes, BIG).astype(np.int32)), files)

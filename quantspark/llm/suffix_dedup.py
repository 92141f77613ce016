"""Suffix-array dedup: repeated byte strings, found by external induced suffix sorting of shards.

A byte that is covered by a string of `window` bytes goes if the same string
also starts earlier: in a document with a smaller id, or earlier in the same
document. Overlaps count, matches never cross documents, and strings are
judged on the input.

1. Anchors. Of the 32-byte strings in a window the least by hash is its anchor;
   equal windows have equal anchors at equal places. Units of texts (see
   `units`) ask which anchors occur twice; windows of others are no repeats.
2. Contexts. The windows that share one occurrence of an anchor are one
   stretch of text, its context. Units ask which of their contexts, by 128-bit
   hashes, begin earlier elsewhere: of those all windows are repeats. The first
   copy of each different context is written to a table of its own.
3. Groups. Different contexts of one anchor share some windows, so contexts
   meet by anchor. A group of more than `hot` contexts is split by where the
   windows lie: those that begin at least k bytes before the anchor by these
   bytes too, the others by the bytes behind it. Halving goes on while a group is
   hot, down to one place, where the group is the copies of one window and is
   settled like a context. So no shard grows with a passage's copies.
4. Suffix arrays. Groups are dealt to shards. `induced` sorts a shard's
   suffixes and gives each one's common prefix with the one before; suffixes
   in a row that share `window` bytes are one class, in which the earliest start
   is no repeat and the others are. The marks go back to the units.
5. Units drop what is repeated. Texts are not shuffled, and a task reads what
   belongs to its own units.

Sums of bytes modulo 2**64 choose anchors and deal rows; 128-bit hashes, or
bytes in suffix arrays, decide. Null and empty texts have no bytes. A text
shorter than the window loses nothing. Rows that repeat a doc_id are taken as
copies of one document: a string at the same start in two of them is no repeat
of itself. A null doc_id counts as the greatest. Removal can cut a character;
the bytes that are left are returned as bytes. A very long text is one unit;
some 60 bytes for each of its bytes must fit a task. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, units
from .induced import suffix_array
from .kernels import U64, chunks, every_hash, mix, prefix_hash, spans_hash, text_bytes, window_minima

#: Bytes of an anchor; different contexts of a group before it is split; contexts in one row of the table of copies.
ANCHOR, HOT, ROW_CONTEXTS = 32, 2048, 2048


class _Contexts:
    """The contexts of a chunk: for each anchor its hash, its place, and the stretch [start, end) of its windows."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, window: int):
        self.raw, self.window, none = raw, window, np.zeros(0, np.int64)
        self.place = self.start = self.end = self.doc = none
        self.hash = np.zeros(0, U64)
        if len(raw) < window:
            return
        h = every_hash(prefix_hash(raw), ANCHOR)
        least = window_minima(h, window - ANCHOR + 1)
        # windows of different documents are apart by those that would cross, so no run of equal anchors joins two
        new = np.zeros(len(least) + 1, bool)
        new[:-1] = True
        same = np.zeros(len(least) + 1, bool)
        same[1:-1] = least[1:] == least[:-1]
        for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            last = max(a, z - window + 1)  # the first start that leaves the document
            same[a : a + 1] = False
            new[last:z] = False
            same[last : last + 1] = False
        inside = new[:-1]
        self.start = np.flatnonzero(inside & ~same[:-1])
        self.end = np.flatnonzero(inside & ~same[1:]) + window
        self.place = least[self.start]
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.hash = h[self.place]


def _positions(unit: units.Unit, window: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(bytes, offsets, the contexts' place, start, end, row and anchor) of a unit."""
    raw, off = text_bytes(unit.texts)
    got: dict[str, list[np.ndarray]] = {k: [np.zeros(0, np.int64)] for k in ("place", "start", "end", "doc")} | {"hash": [np.zeros(0, U64)]}
    for first, _, part, at in chunks(unit.texts):
        c = _Contexts(part, at, window)
        for k in ("place", "start", "end"):
            got[k].append(getattr(c, k) + off[first])
        got["doc"].append(c.doc + first)
        got["hash"].append(c.hash)
    return raw, off, {k: np.concatenate(v) for k, v in got.items()}


def _wide(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of stretches of bytes, as two words."""
    data = raw.data
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:z]) for a, z in zip(start.tolist(), end.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _asked_once(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of each hash's key): different hashes, twice those that occur again."""
    keys, back, n = np.unique(hashes, return_inverse=True, return_counts=True)
    times = np.minimum(n, 2)
    return np.repeat(keys, times), (np.cumsum(times) - times)[back]


def _twice(keys: np.ndarray, _: list[np.ndarray]) -> np.ndarray:
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def _firsts(key: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the first occurrence of each different (key, check), which of them each row belongs to)."""
    by = np.lexsort((start, doc, check, key))
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (check[by][1:] != check[by][:-1])
    back = np.empty(len(by), np.int64)
    back[by] = np.cumsum(new) - 1
    return by[new], back


def _first_here(keys: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """1: the unit's first occurrence is the first of all; 2: one before it is."""
    check, doc, start = values
    first, back = _firsts(keys, check, doc, start)
    own = first[back]
    return np.where((doc == doc[own]) & (start == start[own]), 1, 2)


@dataclass
class _Found:
    """The first copies of a unit's contexts: where their bytes lie in raw, bytes before the anchor, its hash, and where they
    start in the corpus."""

    number: int
    raw: np.ndarray
    at: np.ndarray
    size: np.ndarray
    left: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    answers: dict[str, pa.Table] = field(default_factory=dict)


_COLUMNS = ["unit", "size", "left", "anchor", "doc", "start", "data"]


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[_Found]:
    """The rows of a unit, which follow each other, as one."""

    def found(rows: list[pa.RecordBatch]) -> _Found:
        size, left, anchor, doc, start, raw = (np.frombuffer(b"".join([r.column(i)[0].as_py() for r in rows]), t) for i, t in enumerate((np.int64, np.int64, U64, np.int64, np.int64, np.uint8), 1))
        return _Found(rows[0].column(0)[0].as_py(), raw, np.cumsum(size) - size, size, left, anchor, doc, start)

    single = (b.slice(i, 1) for b in batches for i in range(b.num_rows))
    for _, rows in groupby(single, key=lambda r: r.column(0)[0].as_py()):
        yield found(list(rows))


class _Plan:
    """What units ask, in order; the answers that later steps need go along by name."""

    def __init__(self, bits: int, window: int, hot: int):
        self.bits, self.window, self.hot, self.span, self.levels = bits, window, hot, window - ANCHOR, 0

    def anchors(self, unit: units.Unit) -> tuple[np.ndarray, list[np.ndarray]]:
        return _asked_once(_positions(unit, self.window)[2]["hash"])[0], []

    def repeated(self, unit: units.Unit) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(bytes, offsets, the contexts of repeated anchors, with key, check, id and start in their document)."""
        raw, off, c = _positions(unit, self.window)
        keys, place = _asked_once(c["hash"])
        take = units.told(unit, "anchors", keys, self.bits)[place] > 0
        c = {k: v[take] for k, v in c.items()}
        c["key"], c["check"] = _wide(raw, c["start"], c["end"])
        c["id"], c["from"] = unit.ids[c["doc"]], c["start"] - off[c["doc"]]
        return raw, off, c

    def contexts(self, unit: units.Unit) -> tuple[np.ndarray, list[np.ndarray]]:
        _, _, c = self.repeated(unit)
        first, _ = _firsts(c["key"], c["check"], c["id"], c["from"])
        return c["key"][first], [c["check"][first], c["id"][first], c["from"][first]]

    def found(self, unit: units.Unit) -> tuple[_Found, np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """(first copies, offsets, contexts, which contexts start earlier elsewhere, the first copy that others stand at)."""
        raw, off, c = self.repeated(unit)
        first, back = _firsts(c["key"], c["check"], c["id"], c["from"])
        here = units.told(unit, "contexts", c["key"][first], self.bits) == 1
        own = first[back]
        again = ~here[back] | (c["id"] != c["id"][own]) | (c["from"] != c["from"][own])
        copy = np.where(again, -1, (np.cumsum(here) - 1)[back])
        f = first[here]
        out = _Found(unit.number, raw, c["start"][f], (c["end"] - c["start"])[f], (c["place"] - c["start"])[f], c["hash"][f], c["id"][f], c["from"][f], unit.answers)
        return out, off, c, again, copy

    def _split(self, f: _Found, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """(context, low, high) of the halves of groups that hold a window of the context."""
        middle = (low + high) // 2
        own, low, high = np.append(own, own), np.append(low, middle + 1), np.append(middle, high)
        right = f.size[own] - f.left[own] - ANCHOR
        some = (np.maximum(low, self.span - right) <= np.minimum(high, f.left[own])) & (low <= high)
        return own[some], low[some], high[some]

    def groups(self, f: _Found) -> tuple[list[tuple[np.ndarray, ...]], tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        """Groups as (context, low, high): of windows that begin low to high bytes before the anchor. (of several contexts, hot
        ones of one place; hot ones to be asked about next, and their keys)."""
        sums = prefix_hash(f.raw)
        own, low, high = np.arange(len(f.size)), np.zeros(len(f.size), np.int64), np.full(len(f.size), self.span)
        settled, single = [], []
        for level in range(self.levels + 1):
            begin = f.at[own] + f.left[own]
            before = spans_hash(f.raw, begin - low, begin, sums)
            behind = spans_hash(f.raw, begin + ANCHOR, begin + ANCHOR + self.span - high, sums)
            keys = mix(mix(mix(f.anchor[own] ^ U64(0xD1B54A32D192ED03)) ^ before) ^ behind ^ (low << 8 | high).astype(U64))
            if level == self.levels:
                return settled, single, (own, low, high), keys
            different, back = np.unique(keys, return_inverse=True)
            said = units.told(f, f"groups-{level}", different, self.bits)[back]
            settled.append(tuple(x[said == 1] for x in (own, low, high, keys)))
            one = (said == 2) & (low == high)
            single.append(tuple(x[one] for x in (own, low)))
            more = (said == 2) & ~one
            own, low, high = self._split(f, own[more], low[more], high[more])

    def sizes(self, f: _Found) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, n = np.unique(self.groups(f)[3], return_counts=True)
        return keys, [n]

    def stretches(self, f: _Found) -> tuple[np.ndarray, ...]:
        """(context, bytes from its start, size, key) of the windows of each group of several contexts."""
        settled = self.groups(f)[0]
        own, low, high, keys = (np.concatenate([s[i] for s in settled]) if settled else np.zeros(0, np.int64) for i in range(4))
        right = f.size[own] - f.left[own] - ANCHOR
        most, least = np.minimum(high, f.left[own]), np.maximum(low, self.span - right)
        return own, f.left[own] - most, self.window + most - least, keys

    def windows(self, f: _Found) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, bytes from its start, key, check, first occurrences, back) of the windows of hot groups of one place."""
        single = self.groups(f)[1]
        own, low = (np.concatenate([s[i] for s in single]) if single else np.zeros(0, np.int64) for i in range(2))
        ahead = f.left[own] - low
        key, check = _wide(f.raw, f.at[own] + ahead, f.at[own] + ahead + self.window)
        return own, ahead, key, check, *_firsts(key, check, f.doc[own], f.start[own] + ahead)

    def asked_windows(self, f: _Found) -> tuple[np.ndarray, list[np.ndarray]]:
        own, ahead, key, check, first, _ = self.windows(f)
        return key[first], [check[first], f.doc[own][first], (f.start[own] + ahead)[first]]


def _counted(hot: int):
    def reply(keys: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
        _, back = np.unique(keys, return_inverse=True)
        n = np.bincount(back, values[0])[back]
        return np.where(n < 2, 0, np.where(n <= hot, 1, 2))

    return reply


def repeated_starts(contexts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, starts: np.ndarray, window: int, in_memory: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the windows that start earlier elsewhere. contexts: their bytes one after another; docs, starts:
    where each context lies in the corpus."""
    ends = np.cumsum(sizes + 1)
    text = np.ones(int(ends[-1]) + 1, np.int32)  # 1 ends a context
    owner = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(contexts)) + owner] = contexts.astype(np.int32) + 2
    text[-1] = 0
    order, shared = suffix_array(text, 258, in_memory)
    own = np.searchsorted(ends, order, "right")  # the last symbol has no owner
    room = np.append(ends, 0)[own] - 1 - order
    whole = np.flatnonzero(room >= window)
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # what a suffix shares with the one before that has room: the least on the way
    shared = np.minimum.reduceat(shared, np.append(0, whole[:-1] + 1))
    order, own = order[whole].astype(np.int64), own[whole]
    group = np.cumsum(shared < window)
    offset = order - (ends - sizes - 1)[own]
    doc, start = docs[own], starts[own] + offset
    by = np.lexsort((start, doc, group))
    head = np.append(True, group[by][1:] != group[by][:-1])
    first = by[np.flatnonzero(head)][np.cumsum(np.append(False, group[1:] != group[:-1]))]
    later = (doc != doc[first]) | (start != start[first])
    return own[later], offset[later]


def _marks(found: units.Corpus, plan: _Plan, answers: dict[str, str], shard_bits: int, in_memory: int | None) -> DataFrame:
    """(owner, unit, part, data): of the units' stretches the windows that are repeats, a bit for each start."""

    def send(f: _Found):
        own, ahead, size, key = plan.stretches(f)
        shard = (key >> U64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(key), np.int64)
        meta = np.stack([np.full(len(own), f.number), np.arange(len(own)), f.doc[own], f.start[own] + ahead, size], 1)
        begin, data = f.at[own] + ahead, f.raw.tobytes()
        for s in np.unique(shard).tolist():
            i = np.flatnonzero(shard == s)
            held = b"".join([data[a:z] for a, z in zip(begin[i].tolist(), (begin + size)[i].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([meta[i].tobytes()], pa.binary()), pa.array([held], pa.binary())], ["shard", "meta", "data"])

    window = plan.window

    def sort(t: pa.Table) -> pa.Table:
        meta = np.frombuffer(b"".join(t["meta"].to_pylist()), np.int64).reshape(-1, 5)
        raw = np.frombuffer(b"".join(t["data"].to_pylist()), np.uint8)
        own, offset = repeated_starts(raw, meta[:, 4], meta[:, 2], meta[:, 3], window, in_memory)
        bits = np.zeros((len(meta), 2), U64)
        np.bitwise_or.at(bits, (own, offset >> 6), U64(1) << (offset & 63).astype(U64))
        some = np.flatnonzero(bits.any(1))
        some = some[np.argsort(meta[some, 0], kind="stable")]
        rows = np.stack([meta[some, 1].view(U64), bits[some, 0], bits[some, 1]], 1)
        number, at = np.unique(meta[some, 0], return_index=True)
        del raw, own, offset
        common.tidy()
        data = [x.tobytes() for x in np.split(rows, at[1:])] if len(at) else []
        return pa.table({"owner": pa.array(number >> 32), "unit": pa.array(number), "part": pa.array(np.full(len(number), t["shard"][0].as_py(), np.int32)), "data": pa.array(data, pa.binary())})

    sent = units.each(found, send, "shard int, meta binary, data binary", answers)
    return sent.groupBy("shard").applyInArrow(sort, "owner long, unit long, part int, data binary")


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, hot: int = HOT, shard_bits: int | None = None, in_memory: int | None = None, unit_bytes: int = units.UNIT_BYTES) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, spans): the bytes that are left, and the removed runs as [start, end) pairs.

    window: 64 to 159 bytes, so that the starts of a context fit in 128 bits. shard_bits: leading bits that name a shard, by
    default one for each two parts of the corpus. in_memory: entries of the sort's arrays beyond which they are files.
    """
    if not 64 <= window <= 159:
        raise ValueError("window must be 64 to 159")
    corpus = units.write(docs, id_col, text_col, unit_bytes=unit_bytes)
    plan = _Plan(corpus.bits, window, hot)
    answers = {"anchors": units.ask(corpus, plan.anchors, _twice, [], "suffix-anchors", short=True)[0]}
    answers["contexts"] = units.ask(corpus, plan.contexts, _first_here, [np.uint64, np.int64, np.int64], "suffix-contexts", answers)[0]

    def copies(unit: units.Unit):
        f = plan.found(unit)[0]
        data = f.raw.data
        for i in range(0, len(f.size), ROW_CONTEXTS):
            some = slice(i, i + ROW_CONTEXTS)
            held = b"".join([data[a:z] for a, z in zip(f.at[some].tolist(), (f.at + f.size)[some].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([f.number]), *(pa.array([x[some].tobytes()], pa.binary()) for x in (f.size, f.left, f.anchor, f.doc, f.start)), pa.array([held], pa.binary())], _COLUMNS)

    rows = units.each(corpus, copies, ", ".join(["unit long", *(f"{c} binary" for c in _COLUMNS[1:])]), answers)
    grouped: dict[str, str] = {}
    with common.Scratch() as held:
        found = units.derived(corpus, rows, "suffix-copies", _COLUMNS, _of_rows)
        while True:
            path, _, many = units.ask(found, plan.sizes, _counted(hot), [np.uint32], "suffix-groups", grouped)
            grouped = {**grouped, f"groups-{plan.levels}": held.keep(path)}
            plan.levels += 1
            if not many:
                break
        if plan.levels > 1:
            grouped["windows"] = held.keep(units.ask(found, plan.asked_windows, _first_here, [np.uint64, np.int64, np.int64], "suffix-windows", grouped)[0])
        shard_bits = max(0, corpus.bits - 1) if shard_bits is None else shard_bits
        answers |= grouped | {"marks": held.keep(units.by_owner(corpus, _marks(found, plan, grouped, shard_bits, in_memory), "suffix-marks"))}

    def unit(u: units.Unit):
        f, off, c, again, copy = plan.found(u)
        begin, end = [c["start"][again]], [c["end"][again]]
        own, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # repeated windows of first copies
        marks = u.answers.get("marks")
        if marks is not None and marks.num_rows:
            held = np.frombuffer(b"".join(marks["data"].to_pylist()), U64).reshape(-1, 3)
            which, ahead = np.nonzero(np.unpackbits(np.ascontiguousarray(held[:, 1:]).view(np.uint8), axis=1, bitorder="little"))
            context, skip, _, _ = plan.stretches(f)
            stretch = held[which, 0].astype(np.int64)
            own.append(context[stretch])
            at.append(skip[stretch] + ahead)
        if plan.levels > 1:
            context, ahead, key, _, first, back = plan.windows(f)
            here = units.told(u, "windows", key[first], plan.bits) == 1
            first = first[back]
            later = ~here[back] | (f.doc[context] != f.doc[context[first]]) | (f.start[context] + ahead != f.start[context[first]] + ahead[first])
            own.append(context[later])
            at.append(ahead[later])
        if len(f.size):
            own, at = np.concatenate(own), np.concatenate(at)
            holders = np.flatnonzero(copy >= 0)  # rows that repeat an id hold one copy each
            holders = holders[np.argsort(copy[holders], kind="stable")]
            a, z = np.searchsorted(copy[holders], own), np.searchsorted(copy[holders], own, "right")
            n = z - a
            each = holders[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            begin.append(c["start"][each] + np.repeat(at, n))
            end.append(begin[-1] + window)
        raw = f.raw
        begin, end = np.concatenate(begin), np.concatenate(end)
        cover = np.bincount(begin, minlength=len(raw) + 1) - np.bincount(end, minlength=len(raw) + 1)
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        inside = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
        cut = inside[gone[inside] & gone[inside - 1]] if len(raw) else inside  # a run never crosses documents
        begin = np.unique(np.concatenate([np.flatnonzero(edge > 0), cut]))
        end = np.unique(np.concatenate([np.flatnonzero(edge < 0), cut]))
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[off[1:]] - sums[off[:-1]]
        left, data = raw[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[off]
        first_run = np.searchsorted(begin, off)
        spans = np.stack([begin, end], 1)
        kept = pa.array([left[x:y] for x, y in zip(data[:-1].tolist(), data[1:].tolist(), strict=True)], pa.binary())
        runs = pa.array([(spans[first_run[i] : first_run[i + 1]] - off[i]).tolist() for i in range(len(off) - 1)], pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([pa.array(u.ids, mask=u.null), kept, pa.array(np.diff(off).astype(np.int64)), pa.array(removed.astype(np.int64)), runs], ["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    return units.each(corpus, unit, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<array<bigint>>", answers)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 200) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS i FROM d)
), f AS (
  SELECT k, min({'d': doc_id, 'i': i}) AS first FROM w GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT doc_id, i FROM w JOIN f USING (k) WHERE first <> {'d': doc_id, 'i': i}
), edge AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM gone
), run AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM edge) GROUP BY doc_id, no
), piece AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM run
  UNION ALL SELECT d.doc_id, coalesce(max(run.z), 0), any_value(d.n) FROM d LEFT JOIN run USING (doc_id) GROUP BY d.doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)), '' ORDER BY a) AS h FROM piece JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(sum(z - a), 0) AS BIGINT) AS n_removed, count(run.a) AS n_spans, sha256(unhex(any_value(kept.h))) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN run USING (doc_id) GROUP BY d.doc_id, d.n
"""

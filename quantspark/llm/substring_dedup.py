"""Substring dedup by level-wise doubling of word windows.

A word that is covered by a window of `words` consecutive words goes if the
window's word sequence also starts in a document with a smaller id; windows
are judged on the input.

Levels double from `first` words: all windows of that length are counted, and
windows that occur twice at one length alone are extended to twice that length
(cut to `words` at the end): a longer window is a candidate if the windows at
its start and at its end were repeated. A level without repeats ends the
search. On the last level, a window goes if its first document is another.

Each level is one question (see `units`): a unit of texts sends the hashes of
its different candidates to ranges of hashes, and is answered which of them
are repeated. A passage that every document holds is one row a unit. On the
levels before the last 32 bits of a hash and its range travel, which may name
too many candidates, never too few. On the last level windows are told apart by
128 bits, two hashes of the words' 64-bit hashes: of 10**13 different windows
two are taken as equal with a chance of about 10**-13.

Null and empty texts have no words. Rows that repeat a doc_id are one document
(their windows do not remove each other). A null doc_id counts as the
greatest. A very long text is one unit; its words' arrays, some 60 bytes for
each byte of text, must fit a task. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, units
from .kernels import U64, Words, chunks, grams

#: Words of a window, and of the first level's.
WORDS, FIRST = 13, 7


def lengths(words: int, first: int) -> list[int]:
    """The lengths of the levels: `first`, then always twice that, cut to `words`."""
    out = [min(first, words)]
    while out[-1] < words:
        out.append(min(2 * out[-1], words))
    return out


class _Windows:
    """The windows of a unit that lie within one document: word hashes, and the windows' starts and documents by length."""

    def __init__(self, unit: units.Unit):
        hashes, offsets, at = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
        for _, _, raw, off in chunks(unit.texts):
            w = Words(raw, off)
            hashes.append(w.hash)
            offsets.append(w.off[1:] + at)
            at += len(w.hash)
        self.hash, self.off = np.concatenate(hashes), np.concatenate(offsets)
        self.n_words = np.diff(self.off)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, document) of each window."""
        n = np.maximum(self.n_words - size + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + self.off[:-1][doc], doc


def _asked_short(w: _Windows, ids: np.ndarray, start: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of each window's key among them): different hashes, twice if the unit's own documents repeat them."""
    key, back = np.unique(grams(w.hash, size)[start], return_inverse=True)
    own = ids[doc]
    low, high = np.full(len(key), units.LAST), np.full(len(key), -(2**63))
    np.minimum.at(low, back, own)
    np.maximum.at(high, back, own)
    times = 1 + (low < high)
    return np.repeat(key, times), (np.cumsum(times) - times)[back]


def _twice(keys: np.ndarray, _: list[np.ndarray]) -> np.ndarray:
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def _asked_full(w: _Windows, ids: np.ndarray, start: np.ndarray, doc: np.ndarray, size: int, mask: np.uint64) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(keys, [checks, first documents], place of each window's key among them)."""
    key, check = grams(w.hash, size)[start] & mask, grams(w.hash, size, 1)[start]
    by = np.lexsort((check, key))
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (check[by][1:] != check[by][:-1])
    at = np.flatnonzero(new)
    back = np.empty(len(by), np.int64)
    back[by] = np.cumsum(new) - 1
    own = ids[doc][by]
    low = np.minimum.reduceat(own, at) if len(at) else own
    # windows that the unit's own documents repeat are marked by the lowest bit of their check
    several = np.maximum.reduceat(own, at) > low if len(at) else np.zeros(0, bool)
    check = (check[by][at] & ~U64(1)) | several.astype(U64)
    return key[by][at], [check, low], back


def _first_elsewhere(keys: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """0: one document holds it; 1: this unit's first document is the first of several; 2: the first is before the unit's."""
    check, low = values
    pure = check & ~U64(1)
    by = np.lexsort((low, pure, keys))
    new = np.ones(len(by), bool)
    new[1:] = (keys[by][1:] != keys[by][:-1]) | (pure[by][1:] != pure[by][:-1])
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    first = low[by][at][group]
    several = np.logical_or.reduceat(((check[by] & U64(1)) == 1) | (low[by] > first), at)[group]
    out = np.empty(len(by), np.uint8)
    out[by] = np.where(~several, 0, np.where(low[by] == first, 1, 2))
    return out


class Repeats:
    """The levels' questions over a corpus, and what a unit's windows were answered."""

    def __init__(self, corpus: units.Corpus, words: int, first: int, hash_bits: int = 64):
        self.bits, self.words, self.sizes, self.answers = corpus.bits, words, lengths(words, first), {}
        self.mask, self.found = U64(2**64 - 2 ** (64 - hash_bits)), []
        for i, size in enumerate(self.sizes):
            last, held = i == len(self.sizes) - 1, dict(self.answers)
            if last:
                path, yes, _ = units.ask(corpus, lambda u, s=size: self._question(u, s)[1:3], _first_elsewhere, [np.uint64, np.int64], f"windows-{size}", held)
            else:
                path, yes, _ = units.ask(corpus, lambda u, s=size: (self._question(u, s)[1], []), _twice, [], f"windows-{size}", held, short=True)
            self.found.append(yes)
            if not yes:
                break  # nothing is repeated at this length, so nothing is at twice that
            self.answers[str(size)] = path
        self.complete = str(words) in self.answers

    def _question(self, unit: units.Unit, size: int):
        """((windows, starts, documents), keys, values, places) of a level's candidates."""
        w = _Windows(unit)
        level = self.sizes.index(size)
        start, doc = self._candidates(unit, w, level)
        if size == self.words:
            return (w, start, doc), *_asked_full(w, unit.ids, start, doc, size, self.mask)
        keys, place = _asked_short(w, unit.ids, start, doc, size)
        return (w, start, doc), keys, [], place

    def _candidates(self, unit: units.Unit, w: _Windows, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, document) of the windows of a level whose two ends were repeated on each level before."""
        start, doc = w.of(self.sizes[0])
        for size, longer in zip(self.sizes[:level], self.sizes[1 : level + 1], strict=True):
            keys, place = _asked_short(w, unit.ids, start, doc, size)
            again = np.zeros(len(w.hash) + 1, bool)
            again[start[units.told(unit, str(size), keys, self.bits)[place] > 0]] = True
            start, doc = w.of(longer)
            both = again[start] & again[start + longer - size]
            start, doc = start[both], doc[both]
        return start, doc

    def gone(self, unit: units.Unit) -> tuple[_Windows, np.ndarray]:
        """The unit's windows, and which of its words go."""
        if not self.complete:
            w = _Windows(unit)
            return w, np.zeros(len(w.hash), bool)
        (w, start, doc), keys, (_, low), place = self._question(unit, self.words)
        said = units.told(unit, str(self.words), keys, self.bits)[place]
        first = start[(said == 2) | (said == 1) & (unit.ids[doc] > low[place])]
        cover = np.bincount(first, minlength=len(w.hash) + self.words + 1) - np.bincount(first + self.words, minlength=len(w.hash) + self.words + 1)
        return w, np.cumsum(cover)[: len(w.hash)] > 0


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, first: int = FIRST, hash_bits: int = 64, unit_bytes: int = units.UNIT_BYTES) -> DataFrame:
    """(doc_id, text, n_words, n_removed): the words that are left joined by one space, words before and removed.

    hash_bits under 64 makes the windows' first hash collide, for tests.
    """
    corpus = units.write(docs, id_col, text_col, unit_bytes=unit_bytes)
    repeats = Repeats(corpus, words, first, hash_bits)

    def unit(u: units.Unit):
        w, gone = repeats.gone(u)
        at = 0
        ids = pa.array(u.ids, mask=u.null)
        for a, z, raw, off in chunks(u.texts):
            spans = Words(raw, off, hashed=False)
            left = ~gone[at : at + len(spans.start)]
            at += len(spans.start)
            data, texts = raw.tobytes(), []
            for i, j in zip(spans.off[:-1].tolist(), spans.off[1:].tolist(), strict=True):
                kept = np.flatnonzero(left[i:j]) + i
                texts.append(b" ".join([data[x:y] for x, y in zip(spans.start[kept].tolist(), spans.end[kept].tolist(), strict=True)]))
            sums = np.concatenate([[0], np.cumsum(~left)])
            removed = sums[spans.off[1:]] - sums[spans.off[:-1]]
            yield pa.RecordBatch.from_arrays([ids[a:z], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(w.n_words[a:z]), pa.array(removed)], ["doc_id", "text", "n_words", "n_removed"])

    return units.each(corpus, unit, "doc_id long, text string, n_words long, n_removed long", repeats.answers)


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = 1 << 20) -> DataFrame:
    """(length, n_repeated): doubling goes on from `words`, up to `most`, until no candidates survive; n_repeated sums the
    units' different windows of a length that two documents or more hold (by 32 bits and the range but for the last)."""
    corpus = units.write(docs, id_col, text_col)
    repeats = Repeats(corpus, most, words)
    rows = [(n, r) for n, r in zip(repeats.sizes, repeats.found, strict=False)]
    return docs.sparkSession.createDataFrame(rows, "length int, n_repeated long")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_windows(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), f AS (
  SELECT k, min(doc_id) AS first_doc FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM (SELECT win.doc_id, i FROM win JOIN f USING (k) WHERE first_doc < win.doc_id)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), marked AS (
  SELECT words.*, gone.p IS NOT NULL AS removed FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed) AS text
  FROM marked GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

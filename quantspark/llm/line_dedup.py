"""Line dedup: a sharded minimal perfect hash over the different lines, probed by documents.

A line's key is the line without the characters [\\x20\\x09-\\x0D] at both ends,
A-Z in lower case. A key of at least `least_chars` code points that at least
two documents hold loses all its lines except in the document with the
smallest id.

Each unit of texts (see `units`) sends the 128-bit hash of each of its
different keys, with the least document that holds it there and their number,
to the shard of its leading bits: a line that every document holds is one row a
unit. A shard makes one minimal perfect hash of the first 64 bits of all its
keys; at the hash's numbers lie compact arrays of fingerprints (the other 64
bits), counts of documents (saturating) and first documents. The units' keys
probe the arrays: the fingerprint tells whether the entry is theirs, the count
whether two documents hold it, the first document who keeps it. Neither texts
nor lines are joined, and a task holds its own shard alone.

Keys are told apart by all 128 bits: of 10**12 different lines two are taken as
equal with a chance of about 10**-15.

Null and empty texts are one empty line. Rows that repeat a doc_id are one
document. A null doc_id counts as the greatest. Lines repeated in one document
alone all stay. A very long text is one unit, cut into lines in a task's
memory. An empty table gives an empty result. Other columns can be carried
along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, units
from .perfect_hash import PerfectHash

LEAST_CHARS = 10
_SPACE = b" \t\n\x0b\x0c\r"


def _lines(text: str | None) -> list[bytes]:
    """The keys of a text's lines; bytes.lower changes A-Z alone."""
    return [x.strip(_SPACE) for x in (text or "").encode().lower().split(b"\n")]


def _counts(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


class LineIndex:
    """A shard's perfect hash, and at its numbers the lines' fingerprints, counts of documents and first documents."""

    def __init__(self, k: np.ndarray, prints: np.ndarray, low: np.ndarray, n: np.ndarray):
        """Rows of lines, each as units tell of it: k and prints uint64, the least document, how many documents (in a unit)."""
        by = np.lexsort((low, prints, k))
        k, prints, low, n = k[by], prints[by], low[by], n[by].astype(np.int64)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (prints[1:] != prints[:-1])
        at = np.flatnonzero(new)
        first, most = low[at], np.maximum.reduceat(n, at) if len(at) else n
        several = np.maximum.reduceat(low, at) > first if len(at) else np.zeros(0, bool)
        # rows that repeat one document's id in several units are one document
        count = np.where(several | (most > 1), np.maximum(2, np.add.reduceat(n, at) if len(at) else n), 1)
        k, prints = k[at], prints[at]
        ours = np.ones(len(k), bool)
        ours[1:] = k[1:] != k[:-1]  # of lines whose first 64 bits agree one is hashed, the others are listed
        self.hash = PerfectHash.build(k[ours])
        place = np.empty(self.hash.n, np.int64)
        place[self.hash.number(k[ours])] = np.flatnonzero(ours)
        self.prints, self.count, self.first = prints[place], np.minimum(count, 255).astype(np.uint8)[place], first[place]
        self.listed = [(k[i], prints[i], int(min(count[i], 255)), int(first[i])) for i in np.flatnonzero(~ours).tolist()]

    def probe(self, k: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, first document) of lines; a line that the shard does not hold has count 0."""
        number = self.hash.number(k)
        hit = number >= 0
        hit[hit] = self.prints[number[hit]] == prints[hit]
        count, first = np.zeros(len(k), np.uint8), np.full(len(k), units.LAST)
        count[hit], first[hit] = self.count[number[hit]], self.first[number[hit]]
        for key, fingerprint, n, doc in self.listed:
            same = (k == key) & (prints == fingerprint)
            count[same], first[same] = n, doc
        return count, first


def _told(keys: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """0: one document holds the line; 1: the unit's first document keeps it; 2: a document before the unit's does."""
    prints, low, n = values
    count, first = LineIndex(keys, prints, low, n).probe(keys, prints)
    return np.where(count < 2, 0, np.where(first == low, 1, 2))


def _of_unit(unit: units.Unit, least_chars: int, key_bits: int) -> tuple[list[str], np.ndarray, list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, keys, [prints, least documents, numbers of documents], (row, line, key's place) of the lines that count)."""
    texts = [t or "" for t in unit.texts.to_pylist()]
    seen: dict[bytes, int] = {}
    low: list[int] = []
    last: list[int] = []
    n: list[int] = []
    rows, lines, places = [], [], []
    for i, (text, doc) in enumerate(zip(texts, unit.ids.tolist(), strict=True)):
        for j, key in enumerate(_lines(text)):
            if _counts(key, least_chars):
                h = xxhash.xxh3_128_digest(key)
                at = seen.setdefault(h, len(low))
                if at == len(low):
                    low.append(doc)
                    last.append(doc)
                    n.append(1)
                elif doc != last[at]:
                    low[at], last[at] = min(low[at], doc), doc
                    n[at] += 1
                rows.append(i)
                lines.append(j)
                places.append(at)
    both = np.frombuffer(b"".join(seen), np.uint64).reshape(-1, 2)
    keys = both[:, 0] & np.uint64(2**64 - 2 ** (64 - key_bits))
    return texts, keys, [both[:, 1], np.array(low, np.int64), np.array(n, np.uint32)], (np.array(rows, np.int64), np.array(lines, np.int64), np.array(places, np.int64))


def _without(text: str, lines: set[int]) -> str:
    return "\n".join(x for j, x in enumerate(text.split("\n")) if j not in lines)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, carry: bool = False, key_bits: int = 64, unit_bytes: int = units.UNIT_BYTES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): the text that is left, lines before and dropped; with `carry` also row, the other
    columns as a struct. key_bits under 64 makes the first 64 bits collide, for tests."""
    corpus = units.write(docs, id_col, text_col, common.row_of(docs, text_col) if carry else None, unit_bytes)

    def question(unit: units.Unit) -> tuple[np.ndarray, list[np.ndarray]]:
        return _of_unit(unit, least_chars, key_bits)[1:3]

    path = units.ask(corpus, question, _told, [np.uint64, np.int64, np.uint32], "lines")[0]
    bits = corpus.bits

    def dropped(u: units.Unit) -> tuple[list[str], dict[int, set[int]]]:
        texts, keys, (_, low, _), (row, line, place) = _of_unit(u, least_chars, key_bits)
        said = units.told(u, "lines", keys, bits)[place]
        gone = (said == 2) | (said == 1) & (u.ids[row] > low[place])
        out: dict[int, set[int]] = {}
        for i, j in zip(row[gone].tolist(), line[gone].tolist(), strict=True):
            out.setdefault(i, set()).add(j)
        return texts, out

    def unit(u: units.Unit):
        texts, gone = dropped(u)
        kept = [_without(t, gone[i]) if i in gone else t for i, t in enumerate(texts)]
        n = pa.array([t.count("\n") + 1 for t in texts], pa.int64())
        lost = pa.array([len(gone.get(i, ())) for i in range(len(texts))], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(u.ids, mask=u.null), pa.array(kept, pa.string()), n, lost], ["doc_id", "text", "n_lines", "n_dropped"])

    if not carry:
        return units.each(corpus, unit, "doc_id long, text string, n_lines long, n_dropped long", {"lines": path})

    def lines(u: units.Unit):
        _, gone = dropped(u)
        if gone:
            at = sorted(gone)
            data = pa.array([np.array(sorted(gone[i]), np.int64).tobytes() for i in at], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(u.rids[at]), data], ["rid", "data"])

    told = units.for_rows(corpus, units.each(corpus, lines, "rid long, data binary", {"lines": path}), "lines-dropped")

    def rows(b: pa.RecordBatch, found: np.ndarray, data: pa.Array) -> pa.RecordBatch:
        texts = [t or "" for t in b.column(1).to_pylist()]
        n = pa.array([t.count("\n") + 1 for t in texts], pa.int64())
        lost = np.zeros(len(texts), np.int64)
        for i, x in zip(np.flatnonzero(found).tolist(), data.to_pylist(), strict=True):
            gone = set(np.frombuffer(x, np.int64).tolist())
            texts[i], lost[i] = _without(texts[i], gone), len(gone)
        return pa.RecordBatch.from_arrays([b.column(2), pa.array(texts, pa.string()), n, pa.array(lost)], ["row", "text", "n_lines", "n_dropped"])

    out = units.each_row(corpus, told, rows, f"row {corpus.kind}, text string, n_lines long, n_dropped long")
    return out.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "text", "n_lines", "n_dropped", "row")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), again AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT keyed.*, again.k IS NOT NULL AND doc_id <> first_doc AS gone
  FROM keyed LEFT JOIN again ON keyed.k = again.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

"""BPE encoding and decoding, and the exact token counts that rest on it.

A piece of text is merged with a priority queue of merge ranks over a doubly
linked list of symbols: the queue holds (rank, position, left, right); an
entry is stale when its symbols are no longer at that position, and is
skipped when popped. n symbols cost O(n log n), so a run of a hundred
thousand letters is as safe as a word. Decoding concatenates the
vocabulary's byte strings.

Null and empty texts give no tokens and decode to the empty string; ids
outside the vocabulary raise an error; rows are taken one by one, so repeated
rows and ties need no rule; other columns of the input are left out.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "byte_bpe_50k.json"
#: Pieces, and runs between single spaces, kept with their ids in each Python worker; and the longest that is kept.
CACHE_PIECES, CACHE_RUNS, CACHE_CHARS = 150_000, 250_000, 48
#: A space beside other white space, or at an end: there a run between spaces is not cut as it is within the text.
_UNEVEN = re.compile(r"\s | \s|^ | $")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def vocabulary_path(name_or_path: str = VOCABULARY) -> str:
    """A path as it is; a bare name by way of the installed package of public vocabularies."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Kept(dict):
    """Ids by piece in two generations: when the young one is full it becomes the old one, and what is asked for again returns."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class ByteBpe:
    """A byte-level BPE vocabulary read from its JSON file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for piece, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        for piece, i in added.items():
            self.bytes_of[i] = piece.encode()
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((vocab[a], vocab[b]), (n, vocab[a + b]))
        self.added = added
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")").split if added else lambda t: [t]
        self.pieces = regex.compile(_PIECES).findall
        self.kept = _Kept(lambda piece: self.merge(piece.encode("utf-8", "surrogatepass")), CACHE_PIECES)
        self.runs = _Kept(lambda run: tuple(self._pieces_of(" " + run)), CACHE_RUNS)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        ids = [self.first[b] for b in raw]
        n, rank = len(ids), self.rank
        if n < 2:
            return tuple(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapify(queue)
        while queue:
            _, i, left, right, made = heappop(queue)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue  # stale: one of the two was merged meanwhile
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if r := rank.get((made, ids[k])):
                    heappush(queue, (r[0], i, made, ids[k], r[1]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], made))):
                heappush(queue, (r[0], h, ids[h], made, r[1]))
        return tuple(x for x in ids if x >= 0)

    def _pieces_of(self, text: str):
        return chain.from_iterable(map(self.kept.__getitem__, self.pieces(text)))

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens. A single space always begins a piece, so where spaces stand alone the runs
        between them are encoded one by one, and kept."""
        if _UNEVEN.search(text):
            return list(self._pieces_of(text))
        first, _, rest = text.partition(" ")
        out = list(self._pieces_of(first))
        if rest:
            out.extend(chain.from_iterable(map(self.runs.__getitem__, rest.split(" "))))
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not any(x in text for x in self.added):
            return self._plain(text)
        out: list[int] = []
        for part in self.split(text):
            out.extend([self.added[part]] if part in self.added else self._plain(part))
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def loaded(name_or_path: str = VOCABULARY) -> ByteBpe:
    """The vocabulary, read once in each Python worker."""
    if name_or_path not in _loaded:
        _loaded[name_or_path] = ByteBpe(vocabulary_path(name_or_path))
    return _loaded[name_or_path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each whole text."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(vocabulary)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return common.by_batch(rows, batch, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text): the text of each list of ids."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(vocabulary)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return common.by_batch(rows, batch, f"id {encoded.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, is_exact): each text encoded, its ids decoded, and digests of both.

    Encoding and decoding share one pass, as the ids are several times the size of the text.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(vocabulary)
        n, ids_sha, text_sha, exact = [], [], [], []
        for text in b.column(1):
            text = text.as_py() or ""
            ids = bpe.encode(text)
            back = bpe.decode(ids)
            n.append(len(ids))
            ids_sha.append(sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            exact.append(back == text)
        arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(exact, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "is_exact"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return common.by_batch(rows, batch, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, is_exact boolean")


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens)."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(vocabulary)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.count(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return common.by_batch(rows, batch, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))

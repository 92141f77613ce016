"""Texts in units on the shared folder, and questions about keys that are answered to the unit that asked.

A corpus is written once. Every later pass reads its files whole, and in the
same order, and cuts them alike into units of about UNIT_BYTES of text, so a
unit's keys come out alike in each pass, whatever task or retry computes them.

A question is one packed shuffle. Each unit deals its keys to parts, ranges of
the key's leading bits; a part's task sees all that the units know of its keys
and gives one small number for each; the numbers go back in files by owner
(the task that wrote the units), which the next pass reads for its own units
alone. So what a task reads grows with its own texts, never with the corpus.
Numbers that are all zero are not sent. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a unit (a longer text is a unit of its own); bytes of units, as files, for each part; most parts (2**).
UNIT_BYTES, PART_BYTES, MOST_BITS = 4 << 20, 2 << 20, 18
#: Rows that a reader takes from a file at once.
ROWS = 32
LAST = 2**63 - 1


@dataclass
class Unit:
    """number; numbers of its rows in the corpus, ids (null: LAST), whether they are null, and texts."""

    number: int
    rids: np.ndarray
    ids: np.ndarray
    null: np.ndarray
    texts: pa.Array
    answers: dict[str, pa.Table] = field(default_factory=dict)


@dataclass
class Corpus:
    spark: SparkSession
    path: str
    kind: str  # type of what is carried
    bits: int  # leading bits that name a part
    columns: list[str]
    cut: Callable  # the batches of a file's columns, as units


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None, unit_bytes: int = UNIT_BYTES) -> Corpus:
    """Writes a table, its rows numbered. carry: what else of each row goes along, for `carried`."""
    columns = [F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")]
    rows = docs.select(*columns, *([] if carry is None else [carry.alias("row")]))
    path = common.fresh_dir(docs.sparkSession, "units")
    rows.write.option("maxRecordsPerFile", 0).parquet(path)
    size = _files(docs.sparkSession, path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    kind = "int" if carry is None else rows.schema["row"].dataType.simpleString()
    return Corpus(docs.sparkSession, path, kind, min(MOST_BITS, max(0, int(size // PART_BYTES).bit_length())), ["rid", "id", "text"], partial(of_texts, unit_bytes=unit_bytes))


def of_texts(batches: Iterator[pa.RecordBatch], unit_bytes: int) -> Iterator[Unit]:
    """Units of about unit_bytes; the number of a unit is its file's and its place there."""
    waiting: list[pa.RecordBatch] = []
    size = n = 0

    def unit() -> Unit:
        rids, ids = (pa.concat_arrays([b.column(i) for b in waiting]) for i in (0, 1))
        texts = pa.concat_arrays([b.column(2) for b in waiting])
        return Unit(rids[0].as_py() >> 33 << 32 | n, rids.to_numpy(), ids.fill_null(LAST).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), texts)

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < b.num_rows:
            done = int(ends[first - 1]) if first else 0
            last = min(b.num_rows, max(first + 1, int(np.searchsorted(ends, done + unit_bytes - size, "right"))))
            waiting.append(b.slice(first, last - first))
            size += int(ends[last - 1]) - done
            first = last
            if size >= unit_bytes or first < b.num_rows:
                yield unit()
                waiting, size, n = [], 0, n + 1
    if waiting:
        yield unit()


def carried(corpus: Corpus) -> DataFrame:
    """(rid, text, row): texts, and what is carried. Spark reads it, so any type comes back as it was."""
    return corpus.spark.read.schema(f"rid long, text string, row {corpus.kind}").parquet(corpus.path)


def for_rows(corpus: Corpus, rows: DataFrame, name: str) -> str:
    """Writes what some rows are told (rid, data binary), by the owner of the rows; returns the folder."""
    path = common.fresh_dir(corpus.spark, name)
    owned = rows.select(F.shiftright("rid", 33).alias("owner"), "rid", "data")
    owned.repartition("owner").sortWithinPartitions("owner", "rid").write.partitionBy("owner").parquet(path)
    return path


def each_row(corpus: Corpus, path: str, fn: Callable[[pa.RecordBatch, np.ndarray, pa.Array], pa.RecordBatch], schema: str) -> DataFrame:
    """fn for batches of (rid, text, row), with which rows were told something, and what they were told. A row needs no more than
    its own number, so Spark may split files as it likes; a task reads what the owners of its rows were told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, rids, data = -1, np.zeros(0, np.int64), pa.array([], pa.binary())
        for b in batches:
            own = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own >> 33)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if own[a] >> 33 != owner:
                    owner = int(own[a] >> 33)
                    system, at = _system(f"{path}/owner={owner}")
                    rids, data = np.zeros(0, np.int64), pa.array([], pa.binary())
                    if system.get_file_info(at).type != fs.FileType.NotFound:
                        t = ds.dataset(at, filesystem=system, format="parquet").to_table(columns=["rid", "data"]).sort_by("rid").combine_chunks()
                        if t.num_rows:
                            rids, data = t["rid"].to_numpy(), t["data"].combine_chunks()
                at = np.searchsorted(rids, own[a:z])
                found = np.zeros(z - a, bool)
                inside = at < len(rids)
                found[inside] = rids[at[inside]] == own[a:z][inside]
                yield fn(b.slice(a, z - a), found, data.take(pa.array(at[found])))
            common.tidy()

    return carried(corpus).mapInArrow(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _read(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    system, at = _system(path)
    with system.open_input_file(at) as f:
        yield from pq.ParquetFile(f, pre_buffer=False, buffer_size=1 << 20).iter_batches(batch_size=ROWS, columns=columns)


def _answers(path: str, owner: int) -> pa.Table | None:
    """What one owner's units were answered, in order of unit and part."""
    system, at = _system(f"{path}/owner={owner}")
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return None
    return ds.dataset(at, filesystem=system, format="parquet").to_table(columns=["unit", "part", "data"]).sort_by([("unit", "ascending"), ("part", "ascending")])


def each(corpus: Corpus, fn: Callable[[Unit], Iterator[pa.RecordBatch]], schema: str, answers: dict[str, str] | None = None) -> DataFrame:
    """The batches that fn gives for each unit. answers: by name, the folders of answers that it wants."""
    answers, columns, cut = answers or {}, corpus.columns, corpus.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                held: dict[str, pa.Table | None] = {}
                owner = -1
                for unit in cut(_read(path, columns)):
                    if unit.number >> 32 != owner:
                        owner = unit.number >> 32
                        held = {k: _answers(p, owner) for k, p in answers.items()}
                    for k, t in held.items():
                        if t is not None:
                            a, z = np.searchsorted(t["unit"].to_numpy(), [unit.number, unit.number + 1])
                            unit.answers[k] = t.slice(a, z - a)
                    yield from fn(unit)
                    del unit
                    common.tidy()

    return _files(corpus.spark, corpus.path).select("path").mapInArrow(run, schema)


def derived(corpus: Corpus, rows: DataFrame, name: str, columns: list[str], cut: Callable) -> Corpus:
    """A table made from a corpus's units as a corpus of its own, that can ask as well; a unit's rows follow each other."""
    path = common.fresh_dir(corpus.spark, name)
    rows.write.option("maxRecordsPerFile", 0).parquet(path)
    return Corpus(corpus.spark, path, corpus.kind, corpus.bits, columns, cut)


def dealt(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): the order of keys by value, and where each part begins in it, and the end."""
    order = np.argsort(keys, kind="stable")
    if not bits:
        return order, np.array([0, len(keys)])
    return order, np.append(np.searchsorted(keys[order], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))


def ask(corpus: Corpus, asked: Callable[[Unit], tuple[np.ndarray, list[np.ndarray]]], reply: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], kinds: list, name: str, answers: dict[str, str] | None = None, short: bool = False) -> tuple[str, int, int]:
    """Writes the answers to a question; returns their folder, how many of them are not zero, and how many over 1.

    asked: a unit's keys (uint64, any order, repeats allowed) and values beside them, of the kinds named. reply: all keys of a
    part with their values, in any order; one number from 0 to 255 for each. short: only 32 bits of a key beyond the part's
    travel, the rest are zero in `reply`.
    """
    bits = corpus.bits
    kinds = [np.dtype(np.uint32 if short else np.uint64), *map(np.dtype, kinds)]
    cut = np.uint64(32 - bits)

    def send(unit: Unit) -> Iterator[pa.RecordBatch]:
        keys, values = asked(unit)
        if not len(keys):
            return
        order, edges = dealt(keys, bits)
        keys = keys[order]
        columns = [(keys >> cut).astype(np.uint32) if short else keys, *(np.ascontiguousarray(v[order], k) for v, k in zip(values, kinds[1:], strict=True))]
        full = np.flatnonzero(np.diff(edges)).tolist()
        data = [b"".join([c[edges[p] : edges[p + 1]].tobytes() for c in columns]) for p in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), unit.number)), pa.array(data, pa.binary())], ["part", "unit", "data"])

    def answer(t: pa.Table) -> pa.Table:
        part, width = t["part"][0].as_py(), sum(k.itemsize for k in kinds)
        blocks = t["data"].to_pylist()
        sizes = [len(x) // width for x in blocks]
        columns, skip = [], 0
        for k in kinds:
            columns.append(np.concatenate([np.frombuffer(x, k, n, skip * n) for x, n in zip(blocks, sizes, strict=True)]))
            skip += k.itemsize
        keys = columns[0]
        if short:
            keys = keys.astype(np.uint64) << cut
            if bits:
                keys |= np.uint64(part << (64 - bits))
        said = reply(keys, columns[1:]).astype(np.uint8)
        ends = np.cumsum(sizes)
        some = [(i, said[e - n : e]) for i, (n, e) in enumerate(zip(sizes, ends.tolist(), strict=True)) if said[e - n : e].any()]
        number = t["unit"].to_numpy()[[i for i, _ in some]] if some else np.zeros(0, np.int64)
        data = [b"\1" + x.tobytes() if x.max() > 1 else b"\0" + np.packbits(x).tobytes() for _, x in some]
        if len(keys) > 1 << 16:
            del columns, keys, blocks
            common.tidy()
        yes, many = (pa.array([int(np.count_nonzero(x > n)) for _, x in some], pa.int64()) for n in (0, 1))
        return pa.table({"owner": pa.array(number >> 32), "unit": pa.array(number), "part": pa.array(np.full(len(some), part, np.int32)), "data": pa.array(data, pa.binary()), "yes": yes, "many": many})

    sent = each(corpus, send, "part int, unit long, data binary", answers)
    told = sent.groupBy("part").applyInArrow(answer, "owner long, unit long, part int, data binary, yes long, many long")
    path = by_owner(corpus, told, name)
    sums = corpus.spark.read.schema("yes long, many long").parquet(path).agg(F.coalesce(F.sum("yes"), F.lit(0)), F.coalesce(F.sum("many"), F.lit(0))).first()
    return path, sums[0], sums[1]


def by_owner(corpus: Corpus, rows: DataFrame, name: str) -> str:
    """Writes rows (owner, unit, part, data) where the owner's units look for them; returns the folder."""
    path = common.fresh_dir(corpus.spark, name)
    rows.repartition("owner").write.partitionBy("owner").parquet(path)
    return path


def told(unit: Unit, name: str, keys: np.ndarray, bits: int) -> np.ndarray:
    """The answers (uint8) to a unit's keys, given as they were asked."""
    out = np.zeros(len(keys), np.uint8)
    t = unit.answers.get(name)
    if t is None or not t.num_rows or not len(keys):
        return out
    order, edges = dealt(keys, bits)
    ranked = np.zeros(len(keys), np.uint8)
    for part, data in zip(t["part"].to_pylist(), t["data"].to_pylist(), strict=True):
        a, z = int(edges[part]), int(edges[part + 1])
        said = np.frombuffer(data, np.uint8, offset=1)
        said = said if data[0] else np.unpackbits(said, count=z - a)
        if len(said) != z - a:
            raise RuntimeError("a unit's keys are not those that it asked about")
        ranked[a:z] = said
    out[order] = ranked
    return out


def give(corpus: Corpus, rows: DataFrame, name: str) -> str:
    """Writes places (unit, no) for the units that hold them; returns the folder."""

    def pack(t: pa.Table) -> pa.Table:
        number = t["unit"][0].as_py()
        data = np.sort(t["no"].to_numpy()).astype(np.int32).tobytes()
        return pa.table({"owner": pa.array([number >> 32], pa.int64()), "unit": pa.array([number], pa.int64()), "part": pa.array([0], pa.int32()), "data": pa.array([data], pa.binary())})

    packed = rows.select("unit", "no").groupBy("unit").applyInArrow(pack, "owner long, unit long, part int, data binary")
    return by_owner(corpus, packed, name)


def given(unit: Unit, name: str) -> np.ndarray:
    """The places in a unit that it was given, ascending."""
    t = unit.answers.get(name)
    return np.frombuffer(b"".join(t["data"].to_pylist()), np.int32) if t is not None else np.zeros(0, np.int32)

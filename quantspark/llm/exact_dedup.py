"""Exact dedup by an extendible-hash index on shared files, with DataFrame functions only.

Texts are equal when they are identical without the characters
[\\x20\\x09-\\x0D]. Of equal texts the row with the most code points in the
original text stays, then the one with the smallest doc_id.

The index has one entry for each different text: its 64-bit hash, its SHA-256,
the row that stays and the number of rows. A directory of 2**g slots, addressed
by the first g bits of the hash, points to buckets; while a bucket holds more
entries than its capacity, it is split by one more bit and the directory
doubles where needed. Buckets are numbered in order of their hashes, and each
task owns a range of them: it writes their entries, in order, to one file of
the shared folder. Entries of one hash are a chain, with their bytes.

Copies are compared byte by byte, once a task, before they move: rows of a hash
that occurs again are grouped by hash and bytes where they lie, so a text with
any number of copies is one row a task. A hash that a single row has needs no
bytes. Rows are then looked up, without their texts: the directory names a
row's bucket, in the bucket the hash names the chain, in the chain the SHA-256
the entry. Entries that share hash and SHA-256 but not their bytes are looked
up by their bytes. Buckets with many rows, as of a text that a third of all
rows hold, are copied: a row asks the copy that its id names.

The directory has 2**MOST_DEPTH slots at most; beyond 2**MOST_DEPTH times the
capacity, buckets grow instead, in proportion to the number of texts: more work
for each task, the same answers.

Null counts as the empty text; empty texts are equal to each other. Rows that
repeat a doc_id are rows of their own: each counts in group_size, and all of
them with as many code points as the one that stays are kept when that doc_id
stays. Null doc_ids lose ties. A very long text is one row in the JVM's memory.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Entries in a bucket before it is split, and the most that the directory doubles: 65,536 slots, a literal of the plan.
CAPACITY, MOST_DEPTH = 256, 16
#: Rows that one copy of a bucket answers, in capacities: copies add a quarter of the rows at most.
ROWS_A_COPY = 4
#: Cells of the filter that keeps rows without an equal hash from being shuffled with their text.
CELLS = 1 << 18

Slots = list[tuple[int, int, int]]


def normalised(text: Column) -> Column:
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def directory(hashes: DataFrame, capacity: int = CAPACITY, most_depth: int = MOST_DEPTH) -> Slots:
    """(bucket, its local depth, its copies) of each slot, for rows (h, n): different hashes and how many rows have each.

    One aggregation sums them by their first `most_depth` bits: 2**most_depth sums at most come to the driver.
    """
    cells = hashes.groupBy(F.shiftrightunsigned("h", 64 - most_depth).cast("int").alias("cell")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()
    held = {c["cell"]: (c["k"], c["n"]) for c in cells}
    capacity = max(capacity, -(-sum(k for k, _ in held.values()) >> (most_depth - 1)))
    depth, buckets = 0, {(0, 0): held}  # (prefix, local depth): its cells
    while full := [b for b, c in buckets.items() if sum(k for k, _ in c.values()) > capacity and b[1] < most_depth and b[1] == depth]:
        depth += 1  # the directory doubles; only overfull buckets are split
        for prefix, local in full:
            own = buckets.pop((prefix, local))
            for bit in (0, 1):
                half = prefix * 2 + bit
                buckets[half, local + 1] = {c: n for c, n in own.items() if c >> (most_depth - local - 1) == half}
    slots: dict[int, tuple[int, int, int]] = {}
    for number, (prefix, local) in enumerate(sorted(buckets, key=lambda b: (b[0] << (most_depth - b[1]), b[1]))):
        rows, first = sum(n for _, n in buckets[prefix, local].values()), prefix << (depth - local)
        for slot in range(first, first + (1 << (depth - local))):
            slots[slot] = (number, local, max(1, -(-rows // (ROWS_A_COPY * capacity))))
    return [slots[i] for i in range(len(slots))]


def _slot(slots: Slots) -> Column:
    """The directory's slot for a column h, as a struct (bucket, copies)."""
    depth = (len(slots) - 1).bit_length()
    pages = F.from_json(F.lit(json.dumps([{"bucket": b, "copies": c} for b, _, c in slots])), "array<struct<bucket:int,copies:int>>")
    return F.get(pages, F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64, digest_width: int = 64) -> tuple[DataFrame, DataFrame, DataFrame, Slots]:
    """(keys, texts, index, slots): each row's id, code points, hash and digest; the same with bytes; the entries; the directory.

    hash_bits and digest_width (hexadecimal digits) under 64 make hashes and digests collide, for tests.
    """
    spark = docs.sparkSession
    hashed = F.shiftleft(F.shiftrightunsigned(F.xxhash64("body"), 64 - hash_bits), 64 - hash_bits)
    digest = F.substring("sha", 1, digest_width).alias("digest")
    texts = docs.select(docs[id_col].alias("doc_id"), common.whole_text(text_col).alias("text"))
    texts = texts.select("doc_id", F.char_length("text").cast("long").alias("chars"), normalised(F.col("text")).alias("body")).withColumn("h", hashed)
    keys = common.stored(texts.select("doc_id", "chars", "h", F.sha2("body", 256).alias("sha")), "exact-keys")
    counted = keys.groupBy("h").agg(F.count("*").alias("n"))
    slots = directory(counted, capacity)
    again = counted.filter("n > 1").select("h")
    cell = F.pmod(F.col("h"), F.lit(CELLS))
    cells = F.broadcast(again.select(cell.alias("cell")).distinct())
    copies = texts.join(cells, cell == F.col("cell"), "left_semi").join(again, "h", "left_semi")
    best = F.max_by(F.struct("doc_id", "chars"), F.struct("chars", -F.col("doc_id")))
    made = copies.groupBy("h", "body").agg(best.alias("keep"), F.count("*").alias("group_size")).withColumn("sha", F.sha2("body", 256))
    alone = keys.join(again, "h", "left_anti").select("h", F.lit(None).cast("string").alias("body"), F.struct("doc_id", "chars").alias("keep"), F.lit(1).cast("long").alias("group_size"), "sha")
    entries = made.unionByName(alone).withColumn("bucket", _slot(slots)["bucket"])
    path = common.fresh_dir(spark, "exact-index")
    entries = entries.select("bucket", "h", "sha", "body", "keep", "group_size", digest)
    entries.repartitionByRange("bucket").sortWithinPartitions("bucket", "h", "sha", "body").write.parquet(path)
    return keys.withColumn("digest", digest), texts, spark.read.schema(entries.schema).parquet(path), slots


def chains(index: DataFrame) -> DataFrame:
    """The entries that have bytes, each with its place in the chain of its bucket and hash."""
    return index.filter(F.col("body").isNotNull()).withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha", "body")))


def look_up(keys: DataFrame, texts: DataFrame, index: DataFrame, slots: Slots) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    asked = keys.withColumn("slot", _slot(slots))
    at = F.pmod(F.xxhash64("doc_id", "chars"), F.col("slot.copies")).cast("int")
    asked = asked.select("doc_id", "chars", "h", "sha", "digest", F.col("slot.bucket").alias("bucket"), at.alias("copy"))
    own = ["bucket", "h", "digest"]
    twins = common.stored(index.groupBy(*own).count().filter("count > 1").select(*own), "exact-twins")
    single = index.withColumn("copy", F.explode(F.sequence(F.lit(0), _slot(slots)["copies"] - 1)))
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("chars") == F.col("keep.chars"))
    out = ["doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept")]
    if twins.isEmpty():
        found = asked.join(single.select(*own, "copy", "keep", "group_size"), [*own, "copy"])
        return found.select(*out, F.col("sha").alias("text_sha256"))
    # texts whose bytes differ under one hash and digest: their rows ask with their bytes
    plain = asked.join(twins, own, "left_anti").join(single.join(twins, own, "left_anti").select(*own, "copy", "keep", "group_size"), [*own, "copy"])
    width = F.length(F.first("digest")).alias("width")
    digits = index.agg(width).first()["width"]
    wide = texts.withColumn("bucket", _slot(slots)["bucket"]).withColumn("sha", F.sha2("body", 256)).withColumn("digest", F.substring("sha", 1, digits))
    told = wide.join(twins, own, "left_semi").drop("sha").join(index.join(twins, own, "left_semi"), [*own, "body"])
    return plain.select(*out, F.col("sha").alias("text_sha256")).unionByName(told.select(*out, F.col("sha").alias("text_sha256")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64, digest_width: int = 64) -> DataFrame:
    """One row for each document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    return look_up(*build(docs, id_col, text_col, capacity, hash_bits, digest_width))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""

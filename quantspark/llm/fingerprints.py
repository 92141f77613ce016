"""Document fingerprints: a canonical exact digest, with DataFrame functions only.

A text is put in canonical form (compatibility composition NFKC, full case
folding, NFKC again, each run of white space one space, none at the ends) and
hashed to 128 bits by two xxhash64 of different prefixes. Rows whose digests
are equal are then compared byte by byte: the least and the greatest
canonical text of each digest must be the same. Where they are not, the
digest gets the rank of the text behind it, so equal fingerprints always mean
equal canonical texts.

Null counts as the empty text. Rows that repeat a doc_id are ordered by the
xxhash64 of their text, then by their text. Null doc_ids come last; any other
long is an id like others. A very long text is one row, handled in the JVM's
memory as such: several times its size must fit an executor. Ties and copies
share a fingerprint. An empty table gives an empty result. Only the two named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The most ranges of ids that documents are dealt to, and with it the rows that are broadcast (24 bytes each); rows of a range
#: until then; bounds between two that are looked at first.
MOST_RANGES, ROWS_IN_RANGE, STEP = 65_536, 512, 256
#: Cells of the filter that keeps rows without a partner out of the byte comparison; one 8-byte row each at most.
CELLS = 1 << 18
_DIGEST = "concat(lower(lpad(hex(xxhash64('a', {c})), 16, '0')), lower(lpad(hex(xxhash64('b', {c})), 16, '0')))"


def canonical(text: Column) -> Column:
    """The canonical form of a text; ICU's own functions, called in the JVM."""

    def nfkc(c: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)[\s\x1C-\x1F]+", " "))


def digest(form: str, width: int = 32) -> Column:
    """The wide digest of a canonical column, of `width` hexadecimal digits."""
    return F.expr(_DIGEST.format(c=form)).substr(1, width)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 32) -> DataFrame:
    """(doc_id, fingerprint) of each whole text, collisions told apart."""
    forms = docs.select(docs[id_col].alias("doc_id"), canonical(common.whole_text(text_col)).alias("form"))
    forms = forms.select("doc_id", "form", digest("form", width).alias("digest"))
    ranks = _collisions(forms.select("digest", "form"), forms.select("digest"))
    if ranks is None:
        return forms.select("doc_id", F.col("digest").alias("fingerprint"))
    return _ranked(forms, ranks, "digest", "form", "fingerprint").select("doc_id", "fingerprint")


def _collisions(said: DataFrame, digests: DataFrame) -> DataFrame | None:
    """(digest, form, rank) of the digests that stand for several forms, or None. said: (digest, form) rows.

    Only digests that occur twice are compared: a broadcast filter of CELLS cells keeps most other rows where they lie, and
    the least and the greatest form of each digest are taken before rows move.
    """
    again = digests.groupBy("digest").count().filter("count > 1").select("digest")
    cells = again.select(_cell("digest").alias("cell")).distinct()
    said = said.join(F.broadcast(cells), _cell("digest") == F.col("cell"), "left_semi").join(again, "digest", "left_semi")
    collided = said.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("most")).filter("least != most").select("digest")
    collided = common.stored(collided, "fingerprints")
    if collided.isEmpty():
        return None
    forms = said.join(collided, "digest", "left_semi").groupBy("digest", "form").count()
    return common.stored(forms.select("digest", "form", F.row_number().over(Window.partitionBy("digest").orderBy("form")).alias("rank")), "fingerprints")


def _cell(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(CELLS))


def _place(id_col: str, tie: str) -> list[Column]:
    """Three numbers that ascend as ids descend, nulls last, ties by the hash of a column."""
    key = F.col(id_col)
    return [key.isNull().cast("int").alias("_none"), F.coalesce(F.bitwise_not(key), F.lit(0)).cast("long").alias("_down"), F.xxhash64(tie).alias("_tie")]


_PLACE = ("_none", "_down", "_tie")


def _range_no(bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the ascending bounds a place reaches: a count over every STEP-th bound, then over those between two."""
    kind = "array<struct<a:int,b:bigint,c:bigint>>"
    said = lambda some: [dict(zip("abc", x, strict=True)) for x in some]
    held = lambda x: (x["a"] < F.col("_none")) | (x["a"] == F.col("_none")) & ((x["b"] < F.col("_down")) | (x["b"] == F.col("_down")) & (x["c"] <= F.col("_tie")))
    coarse = F.from_json(F.lit(json.dumps(said(bounds[STEP - 1 :: STEP]))), kind)
    fine = F.from_json(F.lit(json.dumps([said(bounds[i : i + STEP]) for i in range(0, len(bounds) + 1, STEP)])), f"array<{kind}>")
    n = F.size(F.filter(coarse, held))
    return (n * STEP + F.size(F.filter(F.get(fine, n), held))).cast("int")


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", rows_in_range: int = ROWS_IN_RANGE, most_ranges: int = MOST_RANGES) -> DataFrame:
    """Each row with `next_<column>` of the following row by descending id; after the last comes the first.

    Rows are dealt to ranges of (id, hash of the first column), one shuffle. The bounds are quantiles of the places of about
    eight rows a range, taken by hash: they balance the ranges, wherever ids lie, and decide nothing else. Rows of the first
    place of each range are copied to the end of the range before it, by a broadcast list of one place a range.
    """
    placed = docs.select(id_col, *columns, *_place(id_col, columns[0]))
    narrow = docs.select(*_place(id_col, columns[0]))
    n = docs.count()
    ranges = max(1, min(most_ranges, -(-n // rows_in_range)))
    bounds: list[tuple[int, int, int]] = []
    if ranges > 1:
        every = max(1, n // (8 * ranges))
        some = sorted({tuple(r) for r in narrow.filter(F.pmod(F.xxhash64(F.lit(5), *_PLACE), F.lit(every)) == 0).collect()})
        bounds = sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []
    part = _range_no(bounds) if bounds else F.lit(0)
    first = F.min(F.struct(*_PLACE)).alias("first")
    heads = sorted((r["part"], *r["first"]) for r in narrow.groupBy(part.alias("part")).agg(first).collect())
    goes = [(*place, heads[i - 1][0]) for i, (_, *place) in enumerate(heads)]
    copies = F.broadcast(docs.sparkSession.createDataFrame(goes, "_n int, _d long, _t long, _to int"))
    rows = placed.withColumn("_part", part).join(copies, (F.col("_none") == F.col("_n")) & (F.col("_down") == F.col("_d")) & (F.col("_tie") == F.col("_t")), "left")
    own, copy = F.struct(F.lit(0).alias("copy"), F.col("_part").alias("part")), F.struct(F.lit(1).alias("copy"), F.col("_to").alias("part"))
    rows = rows.withColumn("_at", F.explode(F.array_compact(F.array(own, F.when(F.col("_to").isNotNull(), copy)))))
    order = Window.partitionBy("_part").orderBy("_copy", *_PLACE, *columns)
    rows = rows.select(id_col, *columns, *_PLACE, F.col("_at.part").alias("_part"), F.col("_at.copy").alias("_copy"))
    return rows.select(id_col, *columns, "_copy", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter("_copy = 0").drop("_copy")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 32, rows_in_range: int = ROWS_IN_RANGE) -> DataFrame:
    """Fingerprints of each text and of its edited text, with the likeness (1.0 when equal, else 0.0) to the edited text's
    and to the next document's."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))
    texts = texts.withColumn("form", canonical(F.col("text"))).select("doc_id", "text", digest("form", width).alias("digest"))
    pairs = _edited(with_next(texts, ["text", "digest"], rows_in_range=rows_in_range), width)
    narrow = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "digest", "edited_digest", "next_digest")
    narrow = common.stored(narrow, "fingerprints")
    every = narrow.select("digest").unionByName(narrow.select(F.col("edited_digest").alias("digest")))
    own = texts.select("digest", canonical(F.col("text")).alias("form"))
    ranks = _collisions(own.unionByName(pairs.select(F.col("edited_digest").alias("digest"), F.col("edited_form").alias("form"))), every)
    if ranks is None:
        named = narrow.withColumnsRenamed({"digest": "fingerprint", "edited_digest": "edited_fingerprint", "next_digest": "next_fingerprint"})
    else:
        forms = _ranked(texts.withColumn("form", canonical(F.col("text"))), ranks, "digest", "form", "fingerprint")
        full = _edited(with_next(forms.select("doc_id", "text", "fingerprint"), ["text", "fingerprint"], rows_in_range=rows_in_range), width)
        full = _ranked(full, ranks, "edited_digest", "edited_form", "edited_fingerprint")
        named = full.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    alike = lambda other: F.when(F.col("fingerprint") == F.col(other), 1.0).otherwise(0.0)
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next"))


def _edited(pairs: DataFrame, width: int) -> DataFrame:
    """Adds the edited text: the last half of the code points replaced by the first of the next text."""
    half = F.expr("cast(char_length(text) div 2 as int)")
    pairs = pairs.withColumn("edited", F.concat(F.left("text", F.char_length("text") - half), F.left("next_text", half)))
    return pairs.withColumn("edited_form", canonical(F.col("edited"))).withColumn("edited_digest", digest("edited_form", width))


def _ranked(rows: DataFrame, ranks: DataFrame, digest_col: str, form_col: str, name: str) -> DataFrame:
    known = ranks.select(F.col("digest").alias("_d"), F.col("form").alias("_f"), "rank")
    rows = rows.join(known, (F.col(digest_col) == F.col("_d")) & (F.col(form_col) == F.col("_f")), "left")
    return rows.withColumn(name, F.concat(F.col(digest_col), F.coalesce(F.concat(F.lit("-"), F.col("rank").cast("string")), F.lit("")))).drop("_d", "_f", "rank")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(common.table(spark, sf_dir, "documents"))

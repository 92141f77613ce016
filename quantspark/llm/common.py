"""What the operators share: reading tables and passing rows to Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.shared import Scratch, fresh_dir, stored  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_of(docs: DataFrame, *without: str) -> Column:
    """The columns of a table but some, as one struct: no name of an operator's own can clash with them."""
    kept = [c for c in docs.columns if c not in without]
    return F.struct(*[docs[f"`{c}`"] for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("_"))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library

    def _trim(_: int) -> int:
        return 0


def tidy() -> None:
    """Gives memory that is not in use back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
                del out, batch
                tidy()

    return df.mapInArrow(run, schema)

"""Queries and their SQL, one for each operator, over the demonstration drawings of `views`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_geometry, queries_text
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_geometry.system_lengths(spark, sf_dir)


def queries() -> dict[str, Query]:
    return queries_geometry.QUERIES | queries_text.QUERIES


def oracle_sql() -> dict[str, str]:
    own = queries_geometry.ORACLES | queries_text.ORACLES
    with_views = lambda sql: f"WITH RECURSIVE v_seg AS ({V.oracle(V.SEGMENTS)}), v_hit AS ({V.oracle(V.HITS)}), v_ours AS ({V.oracle(V.OURS)}), v_facit AS ({V.oracle(V.FACIT)}){sql}"
    return {name: with_views(sql if sql.lstrip().startswith(",") else " " + sql) for name, sql in own.items()}

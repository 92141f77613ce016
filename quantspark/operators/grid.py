"""Spatial joins by grid cell.

Spark plans a band predicate as a nested loop. Here the one side is written to
its cell, the other to every cell that its reach touches, so the join is an
equality join on (page, cell) with the exact predicate behind it, and a page's
density, not the table's size, bounds a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.functions.geometry import cell

PAGE = ["doc_id", "page_no"]


def cells_of_box(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """An array of (cx, cy) that a box touches; explode it."""
    xs = F.sequence(cell(x0, size), cell(x1, size))
    ys = F.sequence(cell(y0, size), cell(y1, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def at_point(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """Rows with the one cell of a point, in _cx and _cy."""
    return df.withColumns({"_cx": cell(x, size), "_cy": cell(y, size)})


def over_box(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """Rows once for each cell of a box, in _cx and _cy.

    Spark takes them for no more bytes than the rows had, and those for what their files have, so it would broadcast a
    table of any size through the driver: what joins them is a merge join.
    """
    out = df.withColumn("_cell", F.explode(cells_of_box(x0, y0, x1, y1, size))).hint("merge")
    return out.withColumns({"_cx": F.col("_cell.cx"), "_cy": F.col("_cell.cy")}).drop("_cell")


def grid_join(points: DataFrame, boxes: DataFrame, on: Column, keys: list[str] = PAGE, how: str = "inner") -> DataFrame:
    """Joins rows of `at_point` with rows of `over_box` on keys and cell; `on` is exact. A point has one cell, so no pair is
    found twice. Column names of the two sides must differ but for the keys and the cell."""
    names = [*keys, "_cx", "_cy"]
    other = boxes.withColumnsRenamed({c: f"_b_{c}" for c in names})
    same = [points[c] == F.col(f"_b_{c}") for c in names]
    joined = points.join(other, [*same, on], how)
    return joined.drop(*[f"_b_{c}" for c in names], "_cx", "_cy")

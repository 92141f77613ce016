"""Collinear line work: gaps and islands along lines, dash gaps, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.functions import geometry as G

from .grid import PAGE, over_box


def _ends() -> list[Column]:
    return [F.col(c) for c in ("x1", "y1", "x2", "y2")]


def with_line(segments: DataFrame) -> DataFrame:
    """Adds the canonical direction (_dx, _dy; keys _kx, _ky in thousandths), the offset and the projections of both ends."""
    dx, dy = G.unit(*_ends())
    s = segments.withColumns({"_ux": dx, "_uy": dy})
    dx, dy = G.canonical(F.col("_ux"), F.col("_uy"))
    s = s.withColumns({"_dx": dx, "_dy": dy}).drop("_ux", "_uy")
    t1, t2 = G.projection(F.col("_dx"), F.col("_dy"), *_ends()[:2]), G.projection(F.col("_dx"), F.col("_dy"), *_ends()[2:])
    key = lambda c: F.rint(F.col(c) * 1000).cast("long")
    return s.withColumns({"_kx": key("_dx"), "_ky": key("_dy"), "_off": G.offset(F.col("_dx"), F.col("_dy"), *_ends()[:2]), "_t0": F.least(t1, t2), "_t1": F.greatest(t1, t2)})


def island(value: Column, most: float, keys: list[str], order: list[Column], last: Column | None = None) -> tuple[Column, Column]:
    """(starts, window): whether a row begins an island, its value being over `most` beyond the greatest `last` (by default
    the value itself) of the rows before; sum `starts` over the window for the island's number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max(value if last is None else last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(reach.isNull() | (value - reach > most), 1).otherwise(0), w


def offset_runs(lined: DataFrame, tol: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Adds _line: lines of one direction whose offsets follow each other within `tol` are one."""
    keys = [*PAGE, *(by or []), "_kx", "_ky"]
    new, w = island(F.col("_off"), tol, keys, [F.col("_off"), F.col("seg_seq")])
    return lined.withColumn("_new", new).withColumn("_line", F.sum("_new").over(w)).drop("_new")


def merge_collinear(segments: DataFrame, gaps: DataFrame, tol: float = 1.0, crossing_gap: float = 0.0, within_layer: bool = False) -> DataFrame:
    """Dashes of one line become one segment where the gap between them is at most the page's max_gap.

    gaps: (doc_id, page_no, max_gap); pages without a positive gap keep their segments. With crossing_gap, a longer gap is
    bridged too where another line crosses it. Segments without length stay as they are. The first dash gives a merged
    segment its line, pen, colour, layer and seg_seq.
    """
    by = ["layer"] if within_layer else []
    s = segments.join(gaps.select(*PAGE, "max_gap"), PAGE, "left").withColumn("max_gap", F.coalesce("max_gap", F.lit(0.0)))
    still = s.filter((F.col("max_gap") <= 0) | (G.length(*_ends()) == 0))
    runs = offset_runs(with_line(s.filter((F.col("max_gap") > 0) & (G.length(*_ends()) > 0))), tol, by)
    line = Window.partitionBy(*PAGE, *by, "_kx", "_ky", "_line")
    first = F.first(F.struct("_dx", "_dy")).over(line.orderBy("_off", "seg_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    runs = runs.withColumn("_d", first)
    t1 = G.projection(F.col("_d._dx"), F.col("_d._dy"), *_ends()[:2])
    t2 = G.projection(F.col("_d._dx"), F.col("_d._dy"), *_ends()[2:])
    runs = runs.withColumns({"_t0": F.least(t1, t2), "_t1": F.greatest(t1, t2)})
    order = line.orderBy("_t0", "_t1", "_off", "seg_seq")
    reach = F.max("_t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_reach", reach)
    bridged = F.col("_t0") - F.col("_reach") <= F.col("max_gap")
    if crossing_gap:
        runs = _crossed(runs, segments, crossing_gap, by)
        bridged = bridged | F.col("_crossed")
    runs = runs.withColumn("_new", F.when(F.col("_reach").isNull() | ~bridged, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(order))
    keep = ["x1", "y1", "x2", "y2", "width", "r", "g", "b", "layer", "seg_seq", "_d"]
    head = F.min_by(F.struct(*keep), F.struct("_t0", "_t1", "_off", "seg_seq")).alias("f")
    spans = runs.groupBy(*PAGE, *[F.col(c).alias(f"_by_{c}") for c in by], "_kx", "_ky", "_line", "_run").agg(head, F.min("_t0").alias("t0"), F.max("_t1").alias("t1"), F.count("*").alias("n"))
    dx, dy = F.col("f._d._dx"), F.col("f._d._dy")
    base = G.projection(dx, dy, F.col("f.x1"), F.col("f.y1"))
    alone = F.col("n") == 1
    along = lambda t, own, d, start: F.when(alone, F.col(f"f.{own}")).otherwise(F.col(f"f.{start}") + (F.col(t) - base) * d).alias(own)
    merged = spans.select(*PAGE, F.col("f.seg_seq").alias("seg_seq"), along("t0", "x1", dx, "x1"), along("t0", "y1", dy, "y1"), along("t1", "x2", dx, "x1"), along("t1", "y2", dy, "y1"), *[F.col(f"f.{c}").alias(c) for c in ("width", "r", "g", "b", "layer")])
    return still.select(*merged.columns).unionByName(merged)


def crossings(gaps: DataFrame, segments: DataFrame, size: float = 40.0) -> DataFrame:
    """Rows of gaps (page, _ax, _ay, _bx, _by) with each segment that runs across them; once for each cell that both touch."""
    mine = over_box(gaps, F.least("_ax", "_bx"), F.least("_ay", "_by"), F.greatest("_ax", "_bx"), F.greatest("_ay", "_by"), size)
    theirs = over_box(segments, F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), size)
    return mine.join(theirs, [*PAGE, "_cx", "_cy"]).filter(G.segments_cross((F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by")), tuple(_ends())))


def _crossed(runs: DataFrame, segments: DataFrame, crossing_gap: float, by: list[str], size: float = 40.0) -> DataFrame:
    """Adds _crossed: a segment of another line runs across the gap before the row."""
    base = G.projection(F.col("_d._dx"), F.col("_d._dy"), F.col("x1"), F.col("y1"))
    at = lambda t: (F.col("x1") + (t - base) * F.col("_d._dx"), F.col("y1") + (t - base) * F.col("_d._dy"))
    (ax, ay), (bx, by_) = at(F.col("_reach")), at(F.col("_t0"))
    gap = F.col("_t0") - F.col("_reach")
    gaps = runs.filter((gap > F.col("max_gap")) & (gap <= crossing_gap)).select(*PAGE, F.col("seg_seq").alias("_gap"), F.col("_kx").alias("_gx"), F.col("_ky").alias("_gy"), F.col("_line").alias("_gl"), ax.alias("_ax"), ay.alias("_ay"), bx.alias("_bx"), by_.alias("_by"))
    others = runs.select(*PAGE, "x1", "y1", "x2", "y2", "_kx", "_ky", "_line")
    own = (F.col("_kx") == F.col("_gx")) & (F.col("_ky") == F.col("_gy")) & (F.col("_line") == F.col("_gl"))
    found = crossings(gaps, others, size).filter(~own).select(*PAGE, F.col("_gap").alias("seg_seq")).distinct()
    return runs.join(found.withColumn("_crossed", F.lit(True)), [*PAGE, "seg_seq"], "left").withColumn("_crossed", F.coalesce("_crossed", F.lit(False)))


def exact_lines(segments: DataFrame, offset_tol: float = 1.0) -> DataFrame:
    """Segments with length, keyed by _kx, _ky and the offset rounded to a multiple of the tolerance (_ko)."""
    lined = with_line(segments.filter(G.length(*_ends()) > 0))
    return lined.withColumn("_ko", F.rint(F.col("_off") / offset_tol).cast("long"))


def dash_gaps(segments: DataFrame, most: float = 40.0) -> DataFrame:
    """(doc_id, page_no, gap): positive gaps up to `most` between neighbours on one line."""
    w = Window.partitionBy(*PAGE, "_kx", "_ky", "_ko").orderBy("_t0", "_t1")
    reach = F.max("_t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return exact_lines(segments).select(*PAGE, (F.col("_t0") - reach).alias("gap")).filter((F.col("gap") > 0) & (F.col("gap") <= most))


def dash_gap(segments: DataFrame, least: int = 20, margin: float = 1.3) -> DataFrame:
    """(doc_id, page_no, max_gap): the gap at three quarters of a page's sorted gaps, with a margin; 0 under `least` gaps."""
    w = Window.partitionBy(*PAGE)
    ranked = dash_gaps(segments).withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("gap"))})
    found = ranked.filter((F.col("_n") >= least) & (F.col("_i") == F.floor(F.col("_n") * 0.75) + 1))
    pages = segments.select(*PAGE).distinct()
    return pages.join(found.select(*PAGE, (F.col("gap") * margin).alias("max_gap")), PAGE, "left").withColumn("max_gap", F.coalesce("max_gap", F.lit(0.0)))


def coverage(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(page, by, coverage): drawn length over the extent of the lines it lies on; 0 without extent."""
    by = by or []
    lines = exact_lines(segments).withColumn("_len", G.length(*_ends())).groupBy(*PAGE, *by, "_kx", "_ky", "_ko")
    lines = lines.agg(F.sum("_len").alias("ink"), (F.max("_t1") - F.min("_t0")).alias("span"))
    return lines.groupBy(*PAGE, *by).agg(F.coalesce(F.try_divide(F.sum("ink"), F.sum("span")), F.lit(0.0)).alias("coverage"))

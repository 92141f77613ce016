"""Codes out of text hits: filter, dedup, best reading, dimension rows, zones.

Hits that carry equal confidence are ordered by (y0, x0, text, psm), so results don't depend on the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.config import Config, Zone, anchored
from quantspark.functions import codes as C
from quantspark.functions.geometry import Box

from .components import page_components
from .grid import PAGE, at_point, grid_join, over_box

EXCLUDED_BY_ZONE = "exkluderingszon"
_BOX = ("x0", "y0", "x1", "y1")


def text_decision(pages: DataFrame, hits: DataFrame, cfg: Config) -> DataFrame:
    """(page, native_words, use_ocr): OCR is needed where there are few native words; skipping wins over forcing."""
    words = hits.filter("source = 'pdftext'").groupBy(*PAGE).agg(F.count("*").alias("native_words"))
    n = F.coalesce("native_words", F.lit(0))
    decided = F.lit(False) if cfg.skip_ocr else F.lit(True) if cfg.force_ocr else n < cfg.native_word_threshold
    return pages.select(*PAGE).join(words, PAGE, "left").select(*PAGE, n.alias("native_words"), decided.alias("use_ocr"))


def collect_hits(native: DataFrame, ocr: DataFrame, decision: DataFrame, cfg: Config) -> DataFrame:
    """Native words always, OCR of the pages that need it, from the least confidence on; texts trimmed, empty ones left out."""
    good = ocr.filter(F.col("conf") >= cfg.min_conf).join(decision.filter("use_ocr").select(*PAGE), PAGE, "left_semi")
    return native.unionByName(good).withColumn("text", F.trim("text")).filter("text <> ''")


def candidates(hits: DataFrame, cfg: Config) -> DataFrame:
    return hits.filter(C.is_code(F.col("text"), cfg.code_regex))


def duplicate_pairs(hits: DataFrame, tol: float) -> DataFrame:
    """(doc_id, page_no, a, b), a < b: hits of one text whose centres differ by at most tol in x and in y."""
    size, box = max(tol, 1.0), Box.of()
    h = hits.select(*PAGE, "text", "hit_seq", box.cx.alias("mx"), box.cy.alias("my"))
    points = at_point(h, F.col("mx"), F.col("my"), size)
    around = h.select(*PAGE, F.col("text").alias("text2"), F.col("hit_seq").alias("b"), F.col("mx").alias("nx"), F.col("my").alias("ny"))
    around = over_box(around, F.col("nx") - tol, F.col("ny") - tol, F.col("nx") + tol, F.col("ny") + tol, size)
    near = (F.abs(F.col("mx") - F.col("nx")) <= tol) & (F.abs(F.col("my") - F.col("ny")) <= tol)
    pairs = grid_join(points, around, near & (F.col("text") == F.col("text2")) & (F.col("hit_seq") < F.col("b")))
    return pairs.select(*PAGE, F.col("hit_seq").alias("a"), "b")


def clusters(hits: DataFrame, tol: float) -> DataFrame:
    """Hits with `cluster`, the least hit_seq of the page that duplicate pairs lead to."""
    return page_components(hits, duplicate_pairs(hits, tol), "hit_seq", "cluster", PAGE)


def best_of_cluster(clustered: DataFrame) -> DataFrame:
    """One row a cluster: the reading from the text layer first, then the most confident, then by place."""
    rank = F.struct((F.col("source") == "pdftext").cast("int").alias("n"), F.col("conf").alias("c"), (-F.col("y0")).alias("y"), (-F.col("x0")).alias("x"), (-F.col("hit_seq")).alias("s"))
    row = F.struct("hit_seq", "text", *_BOX, "conf")
    best = clustered.groupBy(*PAGE, "cluster").agg(F.max_by(row, rank).alias("h"), F.count("*").alias("raw_cluster_size"), F.min(F.struct("y0", "x0", "hit_seq")).alias("first"))
    return best.select(*PAGE, "h.*", "raw_cluster_size", "first")


def suppress_partial(codes: DataFrame, reach: float = 3.0, size: float = 64.0) -> DataFrame:
    """Leaves out codes whose text is part of a longer code's and whose centre lies in that code's box."""
    box = Box.of()
    points = at_point(codes, box.cx, box.cy, size)
    whole = codes.select(*PAGE, F.col("text").alias("_whole"), *[F.col(c).alias(f"_w{c}") for c in _BOX])
    b = Box.of("_w").expanded(reach)
    whole = over_box(whole, b.x0, b.y0, b.x1, b.y1, size)
    part = (F.length("text") < F.length("_whole")) & F.contains("_whole", "text") & b.contains(box.cx, box.cy)
    return grid_join(points, whole, part, how="left_anti").select(*codes.columns)


def pair_dimensions(codes: DataFrame, hits: DataFrame, cfg: Config, size: float = 64.0) -> DataFrame:
    """Adds `dimension`: the nearest hit under a code without one that looks like a dimension; the first of equal gaps."""
    c, h = Box.of(), Box.of("_h")
    open_ = codes.filter(~C.has_inline_dimension(F.col("base_code"), cfg.dim_part_regex))
    rows = hits.filter(F.col("text").rlike(anchored(cfg.dim_regex)))
    if cfg.codes_are_no_dimensions:
        rows = rows.filter(~C.is_code(F.col("text"), cfg.code_regex))
    rows = rows.select(*PAGE, F.col("text").alias("_dim"), F.col("hit_seq").alias("_hit"), *[F.col(k).alias(f"_h{k}") for k in _BOX])
    gap = h.y0 - c.y1
    wide = F.greatest(F.least(c.width, h.width), F.lit(1.0))
    same = (c.x0 == h.x0) & (c.y0 == h.y0) & (c.x1 == h.x1) & (c.y1 == h.y1)
    fits = gap.between(cfg.pair_gap_min_pt, cfg.pair_gap_max_pt) & (c.h_overlap(h) / wide >= cfg.pair_min_h_overlap) & ~same
    # the hit's top edge meets the band of cells below the code
    below = over_box(open_, c.x0, c.y1 + cfg.pair_gap_min_pt, c.x1, c.y1 + cfg.pair_gap_max_pt, size)
    tops = over_box(rows, h.x0, h.y0, h.x1, h.y0, size).withColumnsRenamed({"_cx": "_rx", "_cy": "_ry", **{k: f"_r_{k}" for k in PAGE}})
    on = [below[k] == F.col(f"_r_{k}") for k in PAGE] + [below["_cx"] == F.col("_rx"), below["_cy"] == F.col("_ry"), fits]
    found = below.join(tops, on).groupBy(*PAGE, "hit_seq").agg(F.min_by("_dim", F.struct(gap.alias("g"), F.col("_hit").alias("s"))).alias("dimension"))
    return codes.join(found, [*PAGE, "hit_seq"], "left")


def in_zones(x: Column, y: Column, zones: tuple[Zone, ...]) -> Column:
    out = F.lit(False)
    for x0, y0, x1, y1 in zones:
        out = out | (x.between(x0, x1) & y.between(y0, y1))
    return out


def in_page_zones(df: DataFrame, x: Column, y: Column, zones: DataFrame) -> DataFrame:
    """Adds _in_zone: the point lies in a zone of its page. zones: (doc_id, page_no, x0, y0, x1, y1), few a page."""
    boxes = zones.groupBy(*PAGE).agg(F.collect_list(F.struct(*_BOX)).alias("_zones"))
    hit = F.exists("_zones", lambda z: x.between(z["x0"], z["x1"]) & y.between(z["y0"], z["y1"]))
    return df.join(boxes, PAGE, "left").withColumn("_in_zone", F.coalesce(hit, F.lit(False))).drop("_zones")


def apply_zones(codes: DataFrame, cfg: Config, zones: DataFrame | None = None) -> DataFrame:
    """Marks (does not drop) codes whose centre lies in an exclusion zone."""
    box = Box.of()
    out = in_page_zones(codes, box.cx, box.cy, zones) if zones is not None else codes.withColumn("_in_zone", F.lit(False))
    hit = F.col("_in_zone") | in_zones(box.cx, box.cy, cfg.exclude_zones)
    return out.withColumns({"excluded": hit, "excluded_reason": F.when(hit, EXCLUDED_BY_ZONE)}).drop("_in_zone")


def extract_codes(hits: DataFrame, cfg: Config, zones: DataFrame | None = None) -> DataFrame:
    """The code table of all pages: hits filtered, clustered, read, cleaned of part readings, numbered by place, with
    dimension rows and zone marks."""
    best = best_of_cluster(clusters(candidates(hits, cfg), cfg.dedup_tol_pt))
    codes = suppress_partial(best).withColumns({"count": C.nx_count(F.col("text")), "base_code": C.nx_base(F.col("text"))})
    order = Window.partitionBy(*PAGE).orderBy("first.y0", "first.x0", "first.hit_seq")
    codes = codes.withColumn("code_id", (F.row_number().over(order) - 1).cast("long")).drop("first")
    codes = apply_zones(pair_dimensions(codes, hits, cfg), cfg, zones)
    return codes.withColumnRenamed("text", "raw_text").withColumn("full_code", C.full_code(F.col("base_code"), F.col("dimension")))

"""Pipe runs out of vector items: expansion, choice of pens or layers, chaining, branches, frames, symbols."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.config import Config
from quantspark.functions import geometry as G
from quantspark.functions import layers as L
from quantspark.shared import stored

from . import islands
from .codes import in_page_zones, in_zones
from .components import page_components
from .grid import PAGE, at_point, grid_join, over_box
from .nets import Net, pruned

ENDS = ("x1", "y1", "x2", "y2")
# Reasons of exclusion.
FRAME_LINE, PAGE_FRAME = "ram/rutnät (lång rak ensam linje)", "sidram"


def _ends() -> list[Column]:
    return [F.col(c) for c in ENDS]


def length() -> Column:
    """The length of a row's segment."""
    return F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def symbols(items: DataFrame, cfg: Config) -> DataFrame:
    """(page, path_id, cx, cy, diameter) of paths that are curves alone and small: marks of vertical pipes."""
    xs, ys = F.filter("coords", lambda _, i: i % 2 == 0), F.filter("coords", lambda _, i: i % 2 == 1)
    box = items.withColumns({"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)})
    paths = box.groupBy(*PAGE, "path_id").agg(F.bool_and(F.col("kind") == "c").alias("curved"), F.min("_x0").alias("x0"), F.max("_x1").alias("x1"), F.min("_y0").alias("y0"), F.max("_y1").alias("y1"))
    d = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    paths = paths.filter(F.col("curved") & (d > 0) & (d <= cfg.symbol_max_diameter_pt))
    return paths.select(*PAGE, "path_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), d.alias("diameter"))


def expand_items(items: DataFrame, cfg: Config) -> DataFrame:
    """Segments of vector items: lines, the sides of rectangles (re: x0, y0, x1, y1) and quads (qu: four corners in order),
    pieces of curves (c). Items of symbol paths and pieces without length are left out; pens and colours have two decimals."""
    c = lambda i: F.col("coords")[i]
    side = lambda a, b, d, e: F.struct(a.alias("x1"), b.alias("y1"), d.alias("x2"), e.alias("y2"))
    line = F.array(side(c(0), c(1), c(2), c(3)))
    x0, y0, x1, y1 = c(0), c(1), c(2), c(3)
    rect = F.array(side(x0, y0, x1, y0), side(x1, y0, x1, y1), side(x1, y1, x0, y1), side(x0, y1, x0, y0))
    quad = F.array(*[side(c(2 * i), c(2 * i + 1), c(2 * i + 2 & 7), c((2 * i + 2 & 7) + 1)) for i in range(4)])
    parts = F.when(F.col("kind") == "l", line).when(F.col("kind") == "re", rect).when(F.col("kind") == "qu", quad).when(F.col("kind") == "c", G.bezier(F.col("coords"), cfg.bezier_steps))
    rest = items.join(symbols(items, cfg).select(*PAGE, "path_id"), [*PAGE, "path_id"], "left_anti")
    out = rest.select(*PAGE, "path_id", "item_seq", *[F.round(v, 2).alias(v) for v in ("width", "r", "g", "b")], "layer", F.posexplode(parts).alias("part", "s"))
    out = out.select(*PAGE, "path_id", "item_seq", "part", "s.*", "width", "r", "g", "b", "layer").filter(length() > 0)
    w = Window.partitionBy(*PAGE).orderBy("path_id", "item_seq", "part")
    return out.withColumn("seg_seq", F.row_number().over(w).cast("long")).drop("path_id", "item_seq", "part")


def width_histogram(segments: DataFrame) -> DataFrame:
    """(page, width, n, r, g, b): segments of each pen and its most frequent colour, the first seen of equals."""
    colors = segments.groupBy(*PAGE, "width", "r", "g", "b").agg(F.count("*").alias("k"), F.min("seg_seq").alias("first"))
    top = F.max_by(F.struct("r", "g", "b"), F.struct("k", -F.col("first"))).alias("c")
    return colors.groupBy(*PAGE, "width").agg(F.sum("k").alias("n"), top).select(*PAGE, "width", "n", "c.*")


def dominant_color(segments: DataFrame, widths: DataFrame, tol: float) -> DataFrame:
    """(page, pen, r, g, b): the most frequent colour among the pens within tol of a wanted one. widths: (page, pen)."""
    colors = segments.groupBy(*PAGE, "width", "r", "g", "b").agg(F.count("*").alias("k"), F.min("seg_seq").alias("first"))
    near = colors.join(widths, PAGE).filter(F.abs(F.col("width") - F.col("pen")) <= F.col("pen") * tol)
    best = F.max_by(F.struct("r", "g", "b"), F.struct("k", -F.col("first"))).alias("c")
    return near.groupBy(*PAGE, "pen").agg(best).select(*PAGE, "pen", "c.*")


def pipe_clusters(segments: DataFrame, cfg: Config) -> DataFrame:
    """(page, pen, r, g, b) of the pens that draw pipes: the configured ones; else of the frequent pens those that draw
    continuous lines, from a share of the widest on; else the widest frequent pen; else the widest pen."""
    given = cfg.pipe_widths or ((cfg.pipe_width,) if cfg.pipe_width is not None else None)
    if given:
        pens = segments.select(*PAGE).distinct().withColumn("pen", F.explode(F.array(*[F.lit(float(w)) for w in given])))
        if cfg.pipe_color:
            return pens.withColumns({c: F.lit(float(v)) for c, v in zip("rgb", cfg.pipe_color, strict=True)})
        return pens.join(dominant_color(segments, pens, cfg.pipe_width_tol), [*PAGE, "pen"], "left")
    w = Window.partitionBy(*PAGE)
    hist = width_histogram(segments).withColumn("total", F.sum("n").over(w))
    often = (F.col("width") > 0) & (F.col("n") >= F.greatest(F.lit(float(cfg.min_cluster_count)), F.col("total") * cfg.min_cluster_frac))
    hist = hist.withColumn("often", often).join(islands.coverage(segments, ["width"]), [*PAGE, "width"], "left")
    whole = F.col("often") & (F.coalesce("coverage", F.lit(0.0)) >= cfg.min_coverage)
    top = lambda cond: F.max(F.when(cond, F.col("width"))).over(w)
    hist = hist.withColumns({"whole": whole, "_w": top(whole), "_o": top(F.col("often")), "_p": top(F.col("width") > 0), "_z": F.max("width").over(w)})
    chosen = F.when(F.col("_w").isNotNull(), F.col("whole") & (F.col("width") >= F.col("_w") * cfg.pipe_width_ratio)).otherwise(F.col("width") == F.coalesce("_o", "_p", "_z"))
    return hist.filter(chosen).select(*PAGE, F.col("width").alias("pen"), "r", "g", "b")


def filter_by_clusters(segments: DataFrame, clusters: DataFrame, cfg: Config, zones: DataFrame | None = None) -> DataFrame:
    """Segments of a chosen pen and colour whose middle lies in no exclusion zone."""
    c = clusters.select(*[F.col(k).alias(f"_{k}") for k in PAGE], "pen", *[F.col(k).alias(f"_{k}") for k in "rgb"])
    color = F.col("_r").isNull() | G.color_close(tuple(F.col(k) for k in "rgb"), tuple(F.col(f"_{k}") for k in "rgb"), cfg.color_tol)
    on = (F.abs(F.col("width") - F.col("pen")) <= F.col("pen") * cfg.pipe_width_tol) & color
    same = [segments[k] == F.col(f"_{k}") for k in PAGE]
    kept = segments.join(c, [*same, on], "left_semi")
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    if zones is not None:
        kept = in_page_zones(kept, mx, my, zones).filter("not _in_zone").drop("_in_zone")
    return kept.filter(~in_zones(mx, my, cfg.exclude_zones))


def layer_lengths(segments: DataFrame) -> DataFrame:
    """(page, layer, length, n) of named layers."""
    return segments.filter(F.coalesce("layer", F.lit("")) != "").groupBy(*PAGE, "layer").agg(F.sum(length()).alias("length"), F.count("*").alias("n"))


def pipe_layers(segments: DataFrame, cfg: Config) -> DataFrame:
    """(page, layer, system) of layers that hold pipes: those chosen by name, else by pattern, else by the layer standard.
    The system comes from the standard's classification only."""
    named = layer_lengths(segments).select(*PAGE, "layer")
    short = L.layer_name(F.col("layer"))
    auto = short.rlike(cfg.pipe_layer_regex) if cfg.pipe_layer_regex else L.is_pipe_layer(F.col("layer"))
    chosen = auto if cfg.pipe_layers is None else short.isin(*cfg.pipe_layers) | F.col("layer").isin(*cfg.pipe_layers)
    return named.filter(chosen).withColumn("system", F.when(auto, L.system_for_layer(F.col("layer"))))


def pipe_segments(segments: DataFrame, cfg: Config, zones: DataFrame | None = None) -> DataFrame:
    """Pipe segments with `system`: by layer on pages that have pipe layers, by pen on the others."""
    if not cfg.use_layers:
        return filter_by_clusters(segments, pipe_clusters(segments, cfg), cfg, zones).withColumn("system", F.lit(None).cast("string"))
    layers = pipe_layers(segments, cfg)
    by_layer = segments.join(layers, [*PAGE, "layer"]).select(*segments.columns, "system")
    if cfg.zones_cut_layer_pipes:
        mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
        if zones is not None:
            by_layer = in_page_zones(by_layer, mx, my, zones).filter("not _in_zone").drop("_in_zone")
        by_layer = by_layer.filter(~in_zones(mx, my, cfg.exclude_zones))
    rest = segments.join(layers.select(*PAGE).distinct(), PAGE, "left_anti")
    by_pen = filter_by_clusters(rest, pipe_clusters(rest, cfg), cfg, zones)
    return by_layer.unionByName(by_pen.withColumn("system", F.lit(None).cast("string")).select(*by_layer.columns))


def endpoint_pairs(segments: DataFrame, tol: float, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """(page, a, b), a < b: segments with ends at most tol apart."""
    keys, size = [*PAGE, *by], max(2 * tol, 1.0)  # a reach of tol either way touches four cells at most
    ends = segments.select(*keys, "seg_seq", F.inline(F.array(F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.col("x2").alias("px"), F.col("y2").alias("py")))))
    other = ends.select(*keys, F.col("seg_seq").alias("b"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    other = over_box(other, F.col("qx") - tol, F.col("qy") - tol, F.col("qx") + tol, F.col("qy") + tol, size)
    near = F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy")) <= tol
    pairs = grid_join(at_point(ends, F.col("px"), F.col("py"), size), other, near & (F.col("seg_seq") < F.col("b")), keys)
    return pairs.select(*PAGE, F.col("seg_seq").alias("a"), "b").distinct()


def chain_groups(segments: DataFrame, tol: float, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Segments with `chain`, the least seg_seq that shared ends lead to, within a page and layer."""
    return page_components(segments, endpoint_pairs(segments, tol, by), "seg_seq", "chain", PAGE)


def cut_at_contacts(segments: DataFrame, tol: float) -> DataFrame:
    """Pieces of segments cut where another end touches their inside; piece_no counts from 0 along the segment.

    Of touching ends closer than tol along a segment the first along it cuts.
    """
    size = max(8 * tol, 8.0)
    ends = segments.select(*PAGE, F.inline(F.array(F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.col("x2").alias("px"), F.col("y2").alias("py"))))).distinct()
    long = segments.filter(length() > 2 * tol).select(*PAGE, "seg_seq", *ENDS, length().alias("len"))
    boxes = over_box(long, F.least("x1", "x2") - tol, F.least("y1", "y2") - tol, F.greatest("x1", "x2") + tol, F.greatest("y1", "y2") + tol, size)
    t = ((F.col("px") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("py") - F.col("y1")) * (F.col("y2") - F.col("y1"))) / F.col("len")
    inside = (t > tol) & (t < F.col("len") - tol) & (G.point_segment_distance(F.col("px"), F.col("py"), *_ends()) <= tol)
    cuts = grid_join(at_point(ends, F.col("px"), F.col("py"), size), boxes, inside).groupBy(*PAGE, "seg_seq").agg(F.array_sort(F.collect_set(t)).alias("ts"))
    far = F.aggregate("ts", F.array().cast("array<double>"), lambda got, x: F.when((F.size(got) == 0) | (x - F.element_at(got, -1) > tol), F.concat(got, F.array(x))).otherwise(got))
    cut = segments.join(cuts.select(*PAGE, "seg_seq", far.alias("ts")), [*PAGE, "seg_seq"], "left")
    places = F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(length()))
    steps = F.transform(F.sequence(F.lit(0), F.size(places) - 2), lambda i: F.struct(i.alias("no"), F.get(places, i).alias("a"), F.get(places, i + 1).alias("z")))
    cut = cut.withColumn("_step", F.explode(steps))
    dx, dy = G.unit(*_ends())
    whole = F.col("ts").isNull()
    at = lambda d, start, own, end: F.when(whole, F.col(own)).otherwise(F.col(start) + F.col(f"_step.{end}") * d)
    new = {"x1": at(dx, "x1", "x1", "a"), "y1": at(dy, "y1", "y1", "a"), "x2": at(dx, "x1", "x2", "z"), "y2": at(dy, "y1", "y2", "z")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in segments.columns], F.col("_step.no").alias("piece_no"))


def prune_stubs(pieces: DataFrame, tol: float, min_len: float, rounds: int = 4) -> DataFrame:
    """Drops pieces under min_len with an end that no other piece of their group shares, up to four times over.

    pieces: (page, group, piece, ends); ends meet when they round to one node of the grid.
    """
    size, kept = max(tol, 0.5), pieces
    key = lambda x: F.rint(F.col(x) / size).cast("long")
    w = Window.partitionBy(*PAGE, "group", "_kx", "_ky")
    for _ in range(rounds):
        ends = kept.select(*PAGE, "group", "piece", (length() < min_len).alias("_short"), F.inline(F.array(*[F.struct(key(a).alias("_kx"), key(b).alias("_ky")) for a, b in (("x1", "y1"), ("x2", "y2"))])))
        others = ends.withColumn("_others", F.size(F.collect_set("piece").over(w)) - 1)
        gone = others.filter("_short and _others = 0").select(*PAGE, "group", "piece").distinct()
        kept = kept.join(gone, [*PAGE, "group", "piece"], "left_anti")
    return kept


def free_ends(pieces: DataFrame, tol: float) -> DataFrame:
    """(page, group, px, py): places where one end alone lies, ends being one place when they round to one node."""
    size = max(tol, 0.5)
    ends = pieces.select(*PAGE, "group", F.inline(F.array(*[F.struct(F.col(a).alias("px"), F.col(b).alias("py")) for a, b in (("x1", "y1"), ("x2", "y2"))])))
    keys = [F.rint(F.col(c) / size).cast("long").alias(f"_{c}") for c in ("px", "py")]
    alone = ends.groupBy(*PAGE, "group", *keys).agg(F.count("*").alias("n"), F.min("px").alias("px"), F.min("py").alias("py"))
    return alone.filter("n = 1").select(*PAGE, "group", "px", "py")


def branch_pieces(pieces: DataFrame, cfg: Config, min_len: DataFrame) -> DataFrame:
    """Pieces with branch_no, order, and layer_seq and layer_piece, the first piece left of the layer: one page and layer's net is grouped,
    pruned and divided at its junctions in one task.

    The walk depends on the order of pieces (seg_seq, piece_no). A layer of one page is some thousands of pieces; pages
    and layers are the parallel axis. min_len: (page, min_len).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seg_seq", "piece_no"], kind="stable").reset_index(drop=True)
        ends = list(pdf[list(ENDS)].itertuples(index=False, name=None))
        least, rows, no = float(pdf["min_len"].iloc[0]), [], 0
        for group in Net(ends, cfg.chain_tol_pt).groups():
            kept = [group[i] for i in pruned([ends[i] for i in group], cfg.chain_tol_pt, least)]
            own = [ends[i] for i in kept]
            runs = Net(own, cfg.chain_tol_pt).branches(cfg.junction_straight_deg) if cfg.split_at_junctions and len(own) > 1 else [list(range(len(own)))] if own else []
            for r in runs:
                rows += [(kept[p], no, k) for k, p in enumerate(r)]
                no += 1
        at = pd.DataFrame(rows, columns=["_i", "branch_no", "place"]).astype("int64")
        out = pdf.loc[at["_i"]].reset_index(drop=True).assign(branch_no=at["branch_no"], place=at["place"])
        first = pdf.loc[at["_i"].min() if len(at) else 0]
        return out.assign(layer_seq=first["seg_seq"], layer_piece=first["piece_no"])

    rows = pieces.join(min_len, PAGE).withColumn("layer", F.coalesce("layer", F.lit("")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", branch_no long, place long, layer_seq long, layer_piece int"
    return rows.groupBy(*PAGE, "layer").applyInPandas(run, schema)


def roll_up(pieces: DataFrame, *keys: str | Column, also: list[Column] = ()) -> DataFrame:
    """Runs out of their pieces, by keys: length_pt, n_segments, whether all lie along an axis, the box, and what else is asked."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return pieces.groupBy(*keys).agg(
        F.sum(length()).alias("length_pt"),
        F.count("*").alias("n_segments"),
        F.bool_and(G.is_axis_aligned(dx, dy)).alias("axis_aligned"),
        F.min(F.least("x1", "x2")).alias("x0"),
        F.min(F.least("y1", "y2")).alias("y0"),
        F.max(F.greatest("x1", "x2")).alias("x1"),
        F.max(F.greatest("y1", "y2")).alias("y1"),
        *also,
    )


def long_enough(runs: DataFrame) -> DataFrame:
    """Runs of at least their page's min_len; shorter ones are scraps of symbols."""
    return runs.filter("length_pt >= min_len")


def build_chains(segments: DataFrame, cfg: Config, scale: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chains, chain_segments). chains: page, chain_id, layer, system, length_pt, box, n_segments, all axis-aligned or not.

    Segments, merged segments and branches are read by several plans each; the last two are written to the shared folder
    once, and segments should be stored by the caller.
    """
    gaps = islands.dash_gap(segments) if cfg.dash_gap_pt is None else segments.select(*PAGE).distinct().withColumn("max_gap", F.lit(float(cfg.dash_gap_pt)))
    systems = stored(segments.groupBy(*PAGE, "layer").agg(F.max("system").alias("system")), "systems")
    merged = islands.merge_collinear(segments, gaps, crossing_gap=cfg.crossing_gap_pt, within_layer=cfg.merge_within_layer)
    pieces = cut_at_contacts(stored(merged, "merged"), cfg.chain_tol_pt)
    least = systems.select(*PAGE).distinct().withColumn("min_len", F.lit(float(cfg.min_branch_pt)))
    if cfg.min_run_m and scale is not None:
        least = least.join(scale.select(*PAGE, "pts_per_meter"), PAGE, "left").select(*PAGE, F.greatest("min_len", F.coalesce(F.col("pts_per_meter") * cfg.min_run_m, F.lit(0.0))).alias("min_len"))
    branches = stored(branch_pieces(pieces, cfg, least), "branches")
    layer_at = F.first(F.struct("layer_seq", "layer_piece")).alias("_layer_at")
    chains = long_enough(roll_up(branches, *PAGE, "layer", "branch_no", also=[layer_at, F.first("min_len").alias("min_len")]))
    w = Window.partitionBy(*PAGE).orderBy("_layer_at", "branch_no")
    chains = chains.withColumn("chain_id", (F.row_number().over(w) - 1).cast("long"))
    numbered = branches.join(chains.select(*PAGE, "layer", "branch_no", "chain_id"), [*PAGE, "layer", "branch_no"])
    parts = numbered.select(*PAGE, "chain_id", F.col("place").alias("piece_no"), "seg_seq", *ENDS, "width")
    named = chains.join(systems.withColumn("layer", F.coalesce("layer", F.lit(""))), [*PAGE, "layer"], "left")
    return named.select(*PAGE, "chain_id", "layer", "system", "length_pt", "n_segments", "axis_aligned", "x0", "y0", "x1", "y1"), parts


def flag_frames(chains: DataFrame, pages: DataFrame, cfg: Config) -> DataFrame:
    """Adds excluded and its reason: long straight lone lines, and runs over nine tenths of the page both ways."""
    c = chains.join(pages.select(*PAGE, "width", "height"), PAGE)
    line = (F.col("n_segments") <= 2) & F.col("axis_aligned") & (F.col("length_pt") >= cfg.frame_len_pt)
    frame = (F.col("x1") - F.col("x0") > F.col("width") * 0.9) & (F.col("y1") - F.col("y0") > F.col("height") * 0.9)
    reason = F.when(frame, PAGE_FRAME).when(line, FRAME_LINE)
    return c.withColumns({"excluded": frame | line, "excluded_reason": reason}).drop("width", "height")


def count_symbols(chains: DataFrame, chain_segments: DataFrame, marks: DataFrame, cfg: Config) -> DataFrame:
    """Adds vertical_symbols: marks whose nearest free end (any end, for runs without) lies within reach, on active runs."""
    active = chain_segments.join(chains.filter("not excluded").select(*PAGE, "chain_id"), [*PAGE, "chain_id"])
    active = active.withColumn("group", F.col("chain_id"))
    free = free_ends(active, cfg.chain_tol_pt)
    closed = active.join(free.select(*PAGE, "group").distinct(), [*PAGE, "group"], "left_anti")
    every = closed.select(*PAGE, "group", F.inline(F.array(*[F.struct(F.col(a).alias("px"), F.col(b).alias("py")) for a, b in (("x1", "y1"), ("x2", "y2"))])))
    reach = cfg.symbol_pipe_tol_pt
    ends = over_box(free.unionByName(every), F.col("px") - reach, F.col("py") - reach, F.col("px") + reach, F.col("py") + reach, max(reach, 1.0))
    d = F.hypot(F.col("cx") - F.col("px"), F.col("cy") - F.col("py"))
    found = grid_join(at_point(marks.select(*PAGE, "path_id", "cx", "cy"), F.col("cx"), F.col("cy"), max(reach, 1.0)), ends, d <= reach)
    nearest = found.groupBy(*PAGE, "path_id").agg(F.min_by("group", F.struct(d.alias("d"), F.col("group").alias("g"))).alias("chain_id"))
    n = nearest.groupBy(*PAGE, "chain_id").agg(F.count("*").alias("vertical_symbols"))
    return chains.join(n, [*PAGE, "chain_id"], "left").withColumn("vertical_symbols", F.coalesce("vertical_symbols", F.lit(0)))


def pipe_pen(segments: DataFrame, cfg: Config) -> DataFrame:
    """(page, pipe_width): on pages with pipe layers the most frequent pen of the pipes, else the first chosen pen."""
    chosen = pipe_segments(segments, cfg)
    n = chosen.groupBy(*PAGE, "width").agg(F.count("*").alias("n"), F.min("seg_seq").alias("first"), F.max(F.col("layer") != "").alias("named"))
    return n.groupBy(*PAGE).agg(F.max_by("width", F.struct("n", -F.col("first"))).alias("pipe_width"))


"""Codes to pipe runs: leader lines, then nearness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.config import Config
from quantspark.functions import geometry as G
from quantspark.functions.geometry import Box

from .grid import PAGE, at_point, grid_join, over_box

_ENDS = ("x1", "y1", "x2", "y2")


def leader_candidates(segments: DataFrame, chain_segments: DataFrame, pipe_width: DataFrame, cfg: Config) -> DataFrame:
    """(page, leader_id, ends): thin, slanting, of moderate length, and no piece of a run. pipe_width: (page, pipe_width)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    thin = segments.join(pipe_width, PAGE).filter(F.col("width") < F.col("pipe_width") * cfg.leader_max_width_ratio)
    thin = thin.filter(F.hypot(dx, dy).between(cfg.leader_min_len_pt, cfg.leader_max_len_pt) & G.is_diagonal(dx, dy, cfg.diagonal_min_deg))
    free = thin.join(chain_segments.select(*PAGE, *_ENDS).distinct(), [*PAGE, *_ENDS], "left_anti")
    w = Window.partitionBy(*PAGE).orderBy("seg_seq")
    return free.select(*PAGE, "seg_seq", *_ENDS, "width", (F.row_number().over(w) - 1).alias("leader_id"))


def nearest_chain(points: DataFrame, chain_segments: DataFrame, reach: float, key: str) -> DataFrame:
    """(page, key, chain_id, distance): the nearest active run of each point (px, py) within reach; of equals the last.

    chain_segments: (page, chain_id, piece_no, ends) of active runs.
    """
    p = at_point(points, F.col("px"), F.col("py"), max(reach, 1.0))
    s = chain_segments.select(*PAGE, "chain_id", "piece_no", *[F.col(c).alias(f"_s{c}") for c in _ENDS])
    a = [F.col(f"_s{c}") for c in _ENDS]
    s = over_box(s, F.least(a[0], a[2]) - reach, F.least(a[1], a[3]) - reach, F.greatest(a[0], a[2]) + reach, F.greatest(a[1], a[3]) + reach, max(reach, 1.0))
    d = G.point_segment_distance(F.col("px"), F.col("py"), *a)
    found = grid_join(p, s, d <= reach).withColumn("distance", d)
    best = F.min_by(F.struct("chain_id", "distance"), F.struct("distance", -F.col("chain_id"), -F.col("piece_no"))).alias("b")
    return found.groupBy(*PAGE, key).agg(best).select(*PAGE, key, "b.*")


def leader_pairs(codes: DataFrame, leaders: DataFrame, chain_segments: DataFrame, cfg: Config) -> DataFrame:
    """(page, code_id, leader_id, flip, chain_id, score): leaders with one end at a code and the other at a run."""
    reach = cfg.leader_code_tol_pt
    ends = leaders.select(*PAGE, "leader_id", F.inline(F.array(*[F.struct(F.lit(f).alias("flip"), F.col(n[0]).alias("nx"), F.col(n[1]).alias("ny"), F.col(f_[0]).alias("px"), F.col(f_[1]).alias("py")) for f, n, f_ in ((0, ("x1", "y1"), ("x2", "y2")), (1, ("x2", "y2"), ("x1", "y1")))])))
    ends = ends.withColumn("end_id", F.col("leader_id") * 2 + F.col("flip"))
    far = nearest_chain(ends, chain_segments, cfg.leader_pipe_tol_pt, "end_id")
    ends = ends.join(far, [*PAGE, "end_id"])
    near = at_point(ends, F.col("nx"), F.col("ny"), reach)
    b = Box.of("_c")
    boxes = codes.filter("not excluded").select(*PAGE, "code_id", *[F.col(c).alias(f"_c{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = b.expanded(reach)
    boxes = over_box(boxes, wide.x0, wide.y0, wide.x1, wide.y1, reach)
    d = b.distance(F.col("nx"), F.col("ny"))
    found = grid_join(near, boxes, wide.contains(F.col("nx"), F.col("ny")) | (d <= reach))
    return found.select(*PAGE, "code_id", "leader_id", "flip", "chain_id", (d + F.col("distance")).alias("score"))


def take_leaders(pairs: DataFrame) -> DataFrame:
    """(page, code_id, leader_id, chain_id): each code in order takes its best leader that no code took before it.

    What a code may take depends on all codes before it, so a page's pairs are one task's work; they are the few that the
    joins left.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        for code, own in p.sort_values(["code_id", "score", "leader_id", "flip"], kind="stable").groupby("code_id", sort=True):
            free = own[~own["leader_id"].isin(taken)]
            if len(free):
                best = free.iloc[0]
                taken.add(best["leader_id"])
                rows.append((p["doc_id"].iloc[0], p["page_no"].iloc[0], code, best["leader_id"], best["chain_id"]))
        return pd.DataFrame(rows, columns=[*PAGE, "code_id", "leader_id", "chain_id"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.groupBy(*PAGE).applyInPandas(run, f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, code_id long, leader_id long, chain_id long")


def link_codes(codes: DataFrame, leaders: DataFrame, chain_segments: DataFrame, cfg: Config) -> DataFrame:
    """Codes with linked_chain and link_method ('leader' or 'proximity', else null)."""
    by_leader = take_leaders(leader_pairs(codes, leaders, chain_segments, cfg)).select(*PAGE, "code_id", F.col("chain_id").alias("_by_leader"))
    box = Box.of()
    left = codes.filter("not excluded").join(by_leader, [*PAGE, "code_id"], "left_anti").select(*PAGE, "code_id", box.cx.alias("px"), box.cy.alias("py"))
    near = nearest_chain(left, chain_segments, cfg.proximity_link_pt, "code_id").select(*PAGE, "code_id", F.col("chain_id").alias("_near"))
    out = codes.join(by_leader, [*PAGE, "code_id"], "left").join(near, [*PAGE, "code_id"], "left")
    method = F.when(F.col("_by_leader").isNotNull(), "leader").when(F.col("_near").isNotNull(), "proximity")
    return out.withColumns({"linked_chain": F.coalesce("_by_leader", "_near"), "link_method": method}).drop("_by_leader", "_near")

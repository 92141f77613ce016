"""The whole plan: hits and vector items of many pages to quantities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.config import Config
from quantspark.operators import codes as C
from quantspark.operators import legend, linking, pipes, quantify
from quantspark.operators import scale as S
from quantspark.operators.grid import PAGE
from quantspark.shared import stored
from quantspark.sources import ocr


@dataclass(frozen=True)
class Result:
    """Tables of a run, keyed by page."""

    segments: DataFrame
    codes: DataFrame
    chains: DataFrame
    chain_segments: DataFrame
    leaders: DataFrame
    scale: DataFrame
    rows: DataFrame
    summary: DataFrame
    checks: DataFrame
    warnings: DataFrame
    statistics: DataFrame
    layers: DataFrame
    text_layer: DataFrame


def run(pages: DataFrame, hits: DataFrame, items: DataFrame, cfg: Config = Config(), zones: DataFrame | None = None, engine: ocr.Engine | None = None) -> Result:  # noqa: B008
    """pages(doc_id, page_no, width, height), hits and items as `sources.schema` says. engine: reads the text of pages that
    have few native words; without one such pages have their native words alone, and forcing OCR is an error.

    Tables that several plans read (hits, segments, chains, codes) are written once to the shared folder.
    """
    if cfg.force_ocr and not cfg.skip_ocr and engine is None:
        raise ValueError("OCR is forced, but no OCR engine is given")
    decision = stored(C.text_decision(pages, hits, cfg), "text-layer")
    if engine is not None:
        hits = C.collect_hits(hits, ocr.words(pages, items, decision, cfg, engine), decision, cfg)
    paths = items.groupBy(*PAGE).agg(F.countDistinct("path_id").alias("vector_paths"))
    text_layer = decision.join(paths, PAGE, "left").na.fill(0, ["vector_paths"]).withColumn("ocr_used", F.col("use_ocr") & F.lit(engine is not None))
    hits = stored(_numbered(hits.withColumn("text", F.trim("text")).filter("text <> ''"), "hit_seq"), "hits")
    lines = stored(legend.text_lines(hits), "lines")
    legend_zones = legend.legend_zone(lines, pages)
    zones = legend_zones if zones is None else zones.select(*legend_zones.columns).unionByName(legend_zones)
    codes = C.extract_codes(hits, cfg, zones)
    scale = stored(S.determine_scale(pages, hits, cfg), "scale")
    segments = stored(pipes.expand_items(items, cfg), "segments")
    chosen = stored(_numbered(pipes.pipe_segments(segments, cfg, zones), "seg_seq"), "pipe-segments")
    chains, parts = pipes.build_chains(chosen, cfg, scale)
    parts = stored(parts, "chain-segments")
    chains = pipes.flag_frames(chains, pages, cfg)
    chains = stored(pipes.count_symbols(chains, parts, pipes.symbols(items, cfg), cfg), "chains")
    active = parts.join(chains.filter("not excluded").select(*PAGE, "chain_id"), [*PAGE, "chain_id"], "left_semi")
    leaders = linking.leader_candidates(segments, parts, pipes.pipe_pen(segments, cfg), cfg)
    codes = stored(linking.link_codes(codes, leaders, active, cfg), "codes")
    systems = legend.systems_of_codes(codes, legend.prefix_map(lines, cfg), cfg)
    rows = stored(quantify.quantity_rows(codes, chains, scale, systems, cfg), "rows")
    summary = quantify.summarise(rows)
    checks = quantify.count_checks(summary, legend.expected_counts(lines, cfg))
    layers = quantify.top_layers(pipes.layer_lengths(segments))
    return Result(segments, codes, chains, parts, leaders, scale, rows, summary, checks, quantify.warnings(scale, rows, checks), quantify.run_summary(codes, chains, rows), layers, text_layer)


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """Numbers from 1 within each page, in the order that the column had."""
    return df.withColumn(column, F.row_number().over(Window.partitionBy(*PAGE).orderBy(column)).cast("long"))

"""The plan around an OCR engine: which pages need it, their tiles, blank ones left out, words back in points.

The engine itself is two functions of the caller's: `render(doc_id, page_no, (x, y, width, height) in pixels, dpi, hidden
layers) -> 2-d array of grey values` and `recognise(grey, psm, lang) -> [(text, x0, y0, x1, y1, conf)] in pixels of the tile`.
Tiles are the parallel axis; a tile is rendered once for all modes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.config import Config
from quantspark.functions import layers as L
from quantspark.operators.grid import PAGE

from . import schema
from .cadpdf import tiles

# A pixel under DARK is ink; ink is measured on a grid of SAMPLES x SAMPLES.
DARK, SAMPLES = 200, 96


@dataclass(frozen=True)
class Engine:
    render: Callable
    recognise: Callable


def ink(grey: np.ndarray) -> float:
    """The share of dark pixels in an even sample of an image."""
    rows, columns = (np.unique(np.linspace(0, n - 1, min(n, SAMPLES)).astype(int)) for n in grey.shape)
    sample = grey[np.ix_(rows, columns)]
    return float((sample < DARK).mean()) if sample.size else 0.0


def hidden_layers(items: DataFrame) -> DataFrame:
    """(page, layers): what is switched off before a page is rendered: pipes, building and site layers, logos."""
    layer = F.col("layer")
    name = L.layer_name(layer)
    hide = L.is_pipe_layer(layer) | L.discipline(layer).isin("K", "A") | F.contains(F.lower(name), F.lit("logo"))
    return items.filter((name != "") & hide).groupBy(*PAGE).agg(F.sort_array(F.collect_set("layer")).alias("layers"))


def words(pages: DataFrame, items: DataFrame, decision: DataFrame, cfg: Config, engine: Engine) -> DataFrame:
    """Hits of the pages that need OCR, as `schema.HITS`; every tile once, its modes one after the other."""
    px = [F.ceil(F.col(c) * cfg.dpi / 72).cast("int").alias(f"px_{c}") for c in ("width", "height")]
    wanted = pages.join(decision.filter("use_ocr").select(*PAGE), PAGE, "left_semi").select(*PAGE, *px)
    cut = tiles(wanted, cfg.tile_px, cfg.tile_overlap).join(wanted, PAGE)
    if cfg.ocr_declutter:
        cut = cut.join(hidden_layers(items), PAGE, "left")
    else:
        cut = cut.withColumn("layers", F.lit(None).cast("array<string>"))
    names = [f.split()[0] for f in schema.HITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = 72 / cfg.dpi
        for b in batches:
            rows = []
            for t in b.itertuples():
                box = (t.tx, t.ty, min(cfg.tile_px, t.px_width - t.tx), min(cfg.tile_px, t.px_height - t.ty))
                grey = engine.render(t.doc_id, t.page_no, box, cfg.dpi, list(t.layers) if t.layers is not None else [])
                if ink(grey) < cfg.min_tile_ink:
                    continue
                for psm in cfg.psm_modes:
                    for text, x0, y0, x1, y1, conf in engine.recognise(grey, psm, cfg.ocr_lang):
                        if text.strip() and conf >= cfg.min_conf:
                            rows.append((t.doc_id, t.page_no, 0, text.strip(), (t.tx + x0) * scale, (t.ty + y0) * scale, (t.tx + x1) * scale, (t.ty + y1) * scale, float(conf), "ocr", psm))
            yield pd.DataFrame(rows, columns=names)

    found = cut.mapInPandas(run, schema.HITS)
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "text", "psm", F.desc("conf"))  # whatever task read the tile
    return found.withColumn("hit_seq", F.row_number().over(order).cast("long") + F.lit(1 << 40))

"""Command line: one PDF page to a bill, a code table, a report, a summary and, with --facit, a validation.

python -m quantspark.cli drawing.pdf --output-dir out --yes
Exit codes: 0 done, 1 a missing file, page or bad value, 2 the scale was turned down.
"""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quantspark import config as C
from quantspark.operators import pipes, validate
from quantspark.plans import engine
from quantspark.sinks import bills, overlay
from quantspark.sources import cadpdf, facit, ocr


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quantspark", description=__doc__.splitlines()[0])
    p.add_argument("input_pdf")
    p.add_argument("--output-dir", default="output")
    p.add_argument("--page", type=int, default=0)
    p.add_argument("--config", help="JSON file; flags override it")
    p.add_argument("--version", action="version", version="1.0")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--dpi", type=int)
    p.add_argument("--tile-size", type=int, dest="tile_px")
    p.add_argument("--overlap", type=float, dest="tile_overlap")
    p.add_argument("--psm", type=lambda s: tuple(int(x) for x in s.split(",")), dest="psm_modes")
    p.add_argument("--lang", dest="ocr_lang")
    p.add_argument("--code-regex")
    p.add_argument("--force-ocr", action="store_true", default=None)
    p.add_argument("--no-ocr", action="store_true", default=None, dest="skip_ocr")
    p.add_argument("--exclude-zone", action="append", type=C.parse_zone, dest="exclude_zones", metavar="X0,Y0,X1,Y1")
    p.add_argument("--pipe-width", type=lambda s: tuple(float(x.replace(",", ".")) for x in s.split(";")), dest="pipe_widths")
    p.add_argument("--pipe-color", type=lambda s: tuple(float(x) for x in s.split(",")))
    p.add_argument("--chain-tol", type=float, dest="chain_tol_pt")
    p.add_argument("--calibrate", action="store_true", help="print the pens of the page and stop")
    p.add_argument("--scale", help="1:50 or 56.7pt/m")
    p.add_argument("--vertikalhojd", type=C.parse_vertical_heights, dest="vertical_heights", metavar="SYSTEM=2.8,...")
    p.add_argument("--facit", help="ground-truth bill, CSV or XLSX")
    p.add_argument("--layers", type=lambda s: tuple(s.split(",")))
    p.add_argument("--yes", action="store_true", help="don't ask about the scale")
    return p


def make_config(args: argparse.Namespace) -> C.Config:
    """The config file's values, overridden by flags that were given."""
    base = C.Config.from_file(args.config) if args.config else C.Config()
    names = {f.name for f in dataclasses.fields(C.Config)}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in vars(args).items() if k in names and v is not None}
    if "vertical_heights" in given:
        given["vertical_heights"] = {**base.vertical_heights, **given["vertical_heights"]}
    return dataclasses.replace(base, **given)


def confirmed(result: engine.Result, doc_id: str, args: argparse.Namespace) -> bool:
    """Shows the scale with the longest run as a reference; asks on a terminal unless --yes."""
    s = bills.of_page(result.scale, doc_id, args.page).first()
    run = bills.of_page(result.chains, doc_id, args.page).filter("not excluded").agg(F.max("length_pt")).first()[0]
    if s.pts_per_meter:
        print(f"Skala ({s.method}): {s.scale_text or '-'} = {s.pts_per_meter:.2f} pt/m" + (f"; längsta sträckan {run / s.pts_per_meter:.1f} m" if run else ""))
    if args.yes or not sys.stdin.isatty():
        return True
    return input("Stämmer skalan? [J/n] ").strip().lower() in ("", "j", "ja", "y", "yes")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ocr_engine: ocr.Engine | None = None) -> int:
    """ocr_engine: reads pages that have few native words (--force-ocr: any page); there is none by default."""
    args = parser().parse_args(argv)
    try:
        cfg = make_config(args)
        if not os.path.exists(args.input_pdf):
            raise ValueError(f"Filen finns inte: {args.input_pdf}")
        spark = spark or SparkSession.builder.appName("quantspark").getOrCreate()
        path, doc = os.path.abspath(args.input_pdf), os.path.basename(args.input_pdf)
        on_page = lambda t: cadpdf.read(spark, [path], t).filter(F.col("page_no") == args.page)
        pages, hits, items = (on_page(t) for t in ("pages", "hits", "items"))
        if pages.isEmpty():
            raise ValueError(f"Sidan {args.page} finns inte i {doc}")
        if args.calibrate:
            print(bills.histogram_text(pipes.expand_items(items, cfg), doc, args.page))
            return 0
        result = engine.run(pages, hits, items, cfg, engine=ocr_engine)
        if not confirmed(result, doc, args):
            return 2
        os.makedirs(args.output_dir, exist_ok=True)
        stem = os.path.join(args.output_dir, C.safe_name(os.path.splitext(doc)[0]))
        out = {"_quantities.csv": bills.bill_csv(result.rows, doc, args.page), "_quantities.xlsx": bills.bill_workbook(result, doc, args.page), "_codes.csv": bills.code_csv(result.codes, doc, args.page)}
        out["_report.txt"] = bills.run_report(result, doc, args.page, args.input_pdf).encode()
        out["_summary.json"] = bills.summary_json(result, doc, args.page).encode()
        drawn, at = bills.of_page(bills.annotations(result, cfg.label_min_m), doc, args.page).orderBy("kind", "key", "geometry").collect(), pages.first()
        lines = [tuple(r) for r in bills.of_page(result.segments, doc, args.page).select("x1", "y1", "x2", "y2").collect()]
        out["_annotations.pdf"] = overlay.overlay_pdf(drawn, at.width, at.height, cfg.layers)
        out["_preview.png"] = overlay.preview_png(lines, drawn, at.width, at.height, cfg.layers)
        if args.facit:
            with open(args.facit, "rb") as f:
                rows = facit.read_xlsx(spark, f.read()) if args.facit.lower().endswith((".xlsx", ".xlsm")) else facit.read_csv(spark, os.path.abspath(args.facit))
            ours = bills.of_page(result.summary, doc, args.page)
            out["_validation.txt"] = "\n".join(validate.report_lines(validate.reconcile(ours, validate.read_facit(rows)))).encode()
        for name, data in out.items():
            with open(stem + name, "wb") as f:
                f.write(data)
        return 0
    except (ValueError, KeyError, OSError) as e:
        print(f"Fel: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

"""Bills and reports. Tables stay distributed; bytes of a file are made for one page at a time, from the rows of its bill."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.functions.numbers import decimal_comma, round_exact
from quantspark.operators.grid import PAGE

# Columns and texts of the bill format.
BILL_COLUMNS = [
    "Version", "Document", "Subject", "Sorterings_siffror", "Sidetikett", "Color", "Kommentarer", "Längd", "unit", "Lager", "Antal_VS",
    "Vertikal_höjd_VS", "Total_vertikalhöjd_VS", "unit2", "Kapitel_i_Sektionsdata", "Exportval_Vs", "Byggdelsnummer", "Kontroll_Vs",
    "Antal", "Källa", "Osäkerhet",
]
CODE_COLUMNS = ["id", "kod", "dimension", "full_kod", "antal(N)", "x", "y", "ocr_confidence", "råa_ocr_träffar", "kopplad_rörsträcka", "kopplingsmetod", "exkluderad", "exkluderingsorsak"]
SUMMARY_COLUMNS = ["Subject", "Lager", "Color", "Antal sträckor", "Total längd (m)", "Antal (st)", "Antal_VS", "Total vertikalhöjd (m)", "Flaggor"]


def bill_table(rows: DataFrame) -> DataFrame:
    """The bill's columns for quantity rows, keyed by page and order."""
    vertical, run = F.col("antal_vs").isNotNull(), F.col("langd_m").isNotNull()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    unit = lambda c: F.when(F.col(c).isNotNull(), "m").otherwise("")
    comment = F.when(vertical, F.col("antal_vs").cast("string")).when(run, F.concat(decimal_comma(F.col("langd_m")), F.lit(" m"))).otherwise("")
    exported = F.when(vertical, "Total vertikal höjd VS").when(run, "Längd").otherwise("")
    values = [F.lit("1.0"), F.col("document"), F.col("subject"), F.lit(""), F.col("sidetikett"), F.col("color"), comment, text("langd_m"), unit("langd_m"), F.col("lager"), text("antal_vs"), text("vertikal_hojd_m"), text("total_vertikalhojd_m"), unit("total_vertikalhojd_m"), F.lit(""), exported, F.lit(""), F.lit("Avmarkerad"), text("antal"), F.col("kalla"), F.col("kommentar")]
    return rows.select(*PAGE, "part", "no", *[v.alias(c) for v, c in zip(values, BILL_COLUMNS, strict=True)])


def code_table(codes: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    middle = lambda a, b: round_exact((F.col(a) + F.col(b)) / 2, 1)
    values = [F.col("code_id"), F.col("raw_text"), text(F.col("dimension")), F.col("full_code"), F.col("count"), middle("x0", "x1"), middle("y0", "y1"), round_exact(F.col("conf"), 1), F.col("raw_cluster_size"), text(F.col("linked_chain")), text(F.col("link_method")), F.when(F.col("excluded"), "ja").otherwise("nej"), text(F.col("excluded_reason"))]
    return codes.select(*PAGE, *[v.cast("string").alias(c) for v, c in zip(values, CODE_COLUMNS, strict=True)])


def of_page(df: DataFrame, doc_id, page_no: int) -> DataFrame:
    return df.filter((F.col("doc_id") == doc_id) & (F.col("page_no") == page_no))


def _csv(columns: list[str], rows) -> bytes:
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=";")
    writer.writerow(columns)
    writer.writerows(rows)
    return out.getvalue().encode("utf-8-sig")


def bill_csv(rows: DataFrame, doc_id, page_no: int = 0) -> bytes:
    """UTF-8 with a byte-order mark, ';' between cells."""
    table = of_page(bill_table(rows), doc_id, page_no).orderBy("part", "no").select(*[f"`{c}`" for c in BILL_COLUMNS])
    return _csv(BILL_COLUMNS, table.collect())


def code_csv(codes: DataFrame, doc_id, page_no: int = 0) -> bytes:
    table = of_page(code_table(codes), doc_id, page_no).orderBy(F.col("id").cast("int")).select(*[f"`{c}`" for c in CODE_COLUMNS])
    return _csv(CODE_COLUMNS, table.collect())


def write_tables(result, path: str) -> None:
    """All pages' bills and code tables as Parquet, partitioned by nothing but size: readers filter by doc_id."""
    bill_table(result.rows).write.mode("overwrite").parquet(f"{path}/bills")
    code_table(result.codes).write.mode("overwrite").parquet(f"{path}/codes")


def _sheet(rows: list[list], fills: dict[str, int]) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>']
    for r, row in enumerate(rows):
        out.append("<row>")
        for value in row:
            style = f' s="{1 if r == 0 else fills[value]}"' if r == 0 or value in fills else ""
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                out.append(f"<c{style}><v>{value}</v></c>")
            else:
                out.append(f'<c{style} t="inlineStr"><is><t xml:space="preserve">{escape("" if value is None else str(value))}</t></is></c>')
        out.append("</row>")
    return "".join([*out, "</sheetData></worksheet>"])


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An XLSX file: bold first rows, cells of colours ('#RRGGBB') filled with them."""
    colors = sorted({v for rows in sheets.values() for row in rows[1:] for v in row if isinstance(v, str) and len(v) == 7 and v[0] == "#"})
    fills = {c: i + 2 for i, c in enumerate(colors)}
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    pattern = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c[1:]}"/></patternFill></fill>' for c in colors)
    cells = '<xf fontId="0" fillId="0"/><xf fontId="1" fillId="0" applyFont="1"/>' + "".join(f'<xf fontId="0" fillId="{i + 2}" applyFill="1"/>' for i in range(len(colors)))
    styles = f'<?xml version="1.0"?><styleSheet {main}><fonts><font/><font><b/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{pattern}</fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs><cellXfs>{cells}</cellXfs></styleSheet>'
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    n = range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>",
        "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{kinds}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0"?><workbook {main} xmlns:r="{kinds}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, sheets, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{kinds}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + f'<Relationship Id="s" Type="{kinds}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": styles,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        for i, rows in zip(n, sheets.values(), strict=True):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(rows, fills))
    return out.getvalue()


def bill_workbook(result, doc_id, page_no: int = 0) -> bytes:
    """The four sheets of one page's bill."""
    page = lambda df: of_page(df, doc_id, page_no)
    bill = page(bill_table(result.rows)).orderBy("part", "no").select(*[f"`{c}`" for c in BILL_COLUMNS]).collect()
    numeric = {7, 10, 11, 12, 18}
    number = lambda v: (int(float(v)) if float(v).is_integer() else float(v)) if v else ""
    rows = [[number(v) if i in numeric else v for i, v in enumerate(r)] for r in bill]
    total = page(result.summary).orderBy("lager", "subject").collect()
    sums = [[r.subject, r.lager, r.color, r.n_strackor, r.total_langd_m if r.n_strackor else "", r.n_punkter or "", r.antal_vs or "", r.total_vertikalhojd_m if r.antal_vs else "", "; ".join(r.flaggor)] for r in total]
    s = page(result.scale).first()
    four = lambda v, none: none if v is None else round(v, 4)
    scale = [["Parameter", "Värde"], ["Metod", s.method], ["Skaltext", s.scale_text or "-"], ["Punkter per meter (använd)", four(s.pts_per_meter, "OKÄND")], ["Titelblock (pt/m)", four(s.title_ppm, "-")], ["Skalstock (pt/m)", four(s.bar_ppm, "-")], *[["VARNING", w] for w in s.warnings]]
    said = [[r.message] for r in page(result.warnings).orderBy("rank", "no", "message").collect()]
    checks = [[r.message] for r in page(result.checks).orderBy("code").collect()]
    return workbook({"Mängdförteckning": [BILL_COLUMNS, *rows], "Summering per kod": [SUMMARY_COLUMNS, *sums], "Skala": scale, "Varningar": [["Varning"], *said, *checks]})


def summary_json(result, doc_id, page_no: int = 0) -> str:
    """Counts, scale, the longest layers and warnings of one page."""
    page = lambda df: of_page(df, doc_id, page_no)
    s, n = page(result.scale).first(), page(result.statistics).first()
    ppm = s.pts_per_meter
    layers = [{"layer": r.name, "length_m": round(r.length / ppm, 1) if ppm else None, "length_pt": round(r.length, 1), "is_pipe": r.is_pipe, "system": r.system} for r in page(result.layers).orderBy("rank").collect()]
    out = {"counts": {k: n[k] for k in n.asDict() if k not in PAGE} if n else {}, "scale": {"pts_per_meter": ppm, "method": s.method, "text": s.scale_text}, "layers": layers}
    out["warnings"] = [r.message for r in page(result.warnings).orderBy("rank", "no", "message").collect()]
    out["count_checks"] = [r.message for r in page(result.checks).orderBy("code").collect()]
    return json.dumps(out, ensure_ascii=False, indent=2)


def run_report(result, doc_id, page_no: int = 0, source: str = "") -> str:
    """One page's run in text: counts, scale, checks, warnings and the pens for calibration."""
    page = lambda df: of_page(df, doc_id, page_no)
    s, n = page(result.scale).first(), page(result.statistics).first()
    chains, codes = page(result.chains), page(result.codes)
    out_of = lambda df: df.filter("excluded").count()
    checks = [r.message for r in page(result.checks).orderBy("code").collect()]
    text = page(result.text_layer).first()
    # Fixed texts: the report's headings and sentences, which readers compare between runs.
    lines = ["KÖRNINGSRAPPORT – mängder ur VVS/VA-ritning", "=" * 60, f"Indata: {source or doc_id}", "", "-- Textlager --", f"Ord i textlagret: {text.native_words}   Vektorbanor: {text.vector_paths}", "OCR: " + ("ja" if text.ocr_used else "behövs, men ingen OCR-motor finns" if text.use_ocr else "nej"), "", "-- Skala --", f"Metod: {s.method}   Skaltext: {s.scale_text or '-'}"]
    lines += ["Punkter per meter: " + (f"{s.pts_per_meter:.4f}" if s.pts_per_meter else "OKÄND"), "", "-- Rördetektering --"]
    lines += [f"Rörsträckor: {n.n_chains} ({out_of(chains)} exkluderade som ram/rutnät)", f"  varav kopplade till kod: {n.n_chains_linked}", f"  varav OKOPPLADE (verifiera manuellt): {n.n_chains - n.n_chains_linked}", "", "-- Koder --"]
    lines += [f"Godkända koder: {n.n_codes} ({out_of(codes)} exkluderade via zoner)", f"  varav kopplade till rör: {n.n_codes_linked}", "", "-- Mängdförteckning --", f"Rader totalt: {n.n_rows}", f"Unika koder: {n.n_unique_codes}", ""]
    lines += ["-- Antals-sanity-check mot legend --", *(checks or ["(inga antalsuppgifter lästa ur legenden)"]), "", "-- Varningar / kända begränsningar --"]
    lines += [f"* {r.message}" for r in page(result.warnings).orderBy("rank", "no", "message").collect()]
    return "\n".join([*lines, "", "-- Kalibreringsunderlag --", histogram_text(result.segments, doc_id, page_no)])


def histogram_text(segments: DataFrame, doc_id, page_no: int = 0) -> str:
    """Pens of one page, the most used first."""
    from quantspark.operators.pipes import width_histogram

    rows = width_histogram(of_page(segments, doc_id, page_no)).orderBy(F.desc("n"), "width").collect()
    color = lambda r: None if r.r is None else (r.r, r.g, r.b)
    return "\n".join(["Linjebredd-histogram (bredd pt : antal segment : vanligaste färg):", *[f"  {r.width:>6.2f} : {r.n:>6d} : {color(r)}" for r in rows]])


def annotations(result, label_min_m: float = 1.0, most_labels: int = 400) -> DataFrame:
    """(page, kind, key, geometry, color, label) to draw over a page: runs, their labels, code boxes, code-run links.

    Labels are drawn for all runs of a page or, where it has more than most_labels, for none.
    """
    from quantspark.functions.colors import color_for_code

    codes = result.codes.filter("not excluded")
    first = codes.filter(F.col("linked_chain").isNotNull()).groupBy(*PAGE, F.col("linked_chain").alias("chain_id")).agg(F.min_by("full_code", "code_id").alias("code"))
    runs = result.chains.filter("not excluded").join(first, [*PAGE, "chain_id"], "left").join(result.scale.select(*PAGE, "pts_per_meter"), PAGE, "left")
    color = F.when(F.col("code").isNotNull(), color_for_code(F.col("code"))).otherwise("#FF0000")
    parts = result.chain_segments.join(runs.select(*PAGE, "chain_id", color.alias("color")), [*PAGE, "chain_id"])
    line = F.array("x1", "y1", "x2", "y2")
    none = F.lit(None).cast("string")
    pieces = parts.select(*PAGE, F.lit("pipe").alias("kind"), F.col("chain_id").alias("key"), line.alias("geometry"), "color", none.alias("label"))
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    anchor = parts.groupBy(*PAGE, "chain_id").agg(F.max_by(F.array((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2), F.struct(size.alias("s"), (-F.col("piece_no")).alias("p"))).alias("at"))
    meters = F.col("length_pt") / F.col("pts_per_meter")
    count = runs.groupBy(*PAGE).agg(F.count("*").alias("_n")).filter(F.col("_n") <= most_labels)
    named = runs.join(count, PAGE).join(anchor, [*PAGE, "chain_id"]).filter(meters.isNull() | (meters >= label_min_m))
    text = F.concat_ws(" ", "code", F.coalesce(F.concat(decimal_comma(meters), F.lit(" m")), F.concat(decimal_comma(F.col("length_pt")), F.lit(" pt"))))
    labels = named.select(*PAGE, F.lit("label").alias("kind"), F.col("chain_id").alias("key"), F.col("at").alias("geometry"), F.lit("#000000").alias("color"), text.alias("label"))
    boxes = codes.select(*PAGE, F.lit("code").alias("kind"), F.col("code_id").alias("key"), F.array("x0", "y0", "x1", "y1").alias("geometry"), color_for_code(F.col("full_code")).alias("color"), F.col("full_code").alias("label"))
    to = anchor.withColumnRenamed("chain_id", "linked_chain")
    links = codes.join(to, [*PAGE, "linked_chain"]).select(*PAGE, F.lit("link").alias("kind"), F.col("code_id").alias("key"), F.concat(F.array((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2), "at").alias("geometry"), F.lit("#00C000").alias("color"), F.col("link_method").alias("label"))
    return pieces.unionByName(labels).unionByName(boxes).unionByName(links)

"""Quantities: rows of runs, verticals and points, their summary, and checks against the legend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.config import UNKNOWN, Config
from quantspark.functions.colors import color_for_code
from quantspark.functions.geometry import Box
from quantspark.functions.numbers import round_exact

from .grid import PAGE

# The texts of results.
UNLINKED, UNLABELLED, VERTICAL = "OKOPPLAD RÖRSTRÄCKA", " (omärkt sträcka)", " Vertikal"
FLAG_POINTS, FLAG_UNLINKED, FLAG_COMPONENT = "skala okänd (längd i pt)", "okopplad rörsträcka", "punktkomponent (ej kopplad till rörsträcka)"
WARN_NO_SCALE = "SKALA OKÄND – längder anges i PDF-punkter, inte meter. Mängderna kan INTE användas för kalkyl förrän skalan är satt (--scale)."
WARN_VERTICAL = "Vertikalhöjder är fasta konfigurerade antaganden per system (--vertikalhojd) – en planvy visar aldrig vertikal höjd geometriskt. Måste verifieras av användaren."
WARN_OCR = "OCR är inte 100 % träffsäker på tät, liten CAD-text – enstaka koder kan saknas eller feltolkas (S/5, B/8, O/0). Mängderna är en UPPSKATTNING, inte en exakt mängdförteckning."
COUNT_CHECK = "Antals-sanity-check: "


def primary_codes(chains: DataFrame, codes: DataFrame) -> DataFrame:
    """(page, chain_id, code columns): of the codes linked to a run the one whose centre is nearest to the run's box."""
    box, c = Box.of("_k"), Box.of()
    boxes = chains.select(*PAGE, F.col("chain_id").alias("linked_chain"), *[F.col(k).alias(f"_k{k}") for k in ("x0", "y0", "x1", "y1")])
    linked = codes.filter(F.col("linked_chain").isNotNull()).join(boxes, [*PAGE, "linked_chain"])
    row = F.struct("code_id", "raw_text", "base_code", "full_code", "count", "conf")
    best = F.min_by(row, F.struct(box.distance(c.cx, c.cy).alias("d"), F.col("code_id").alias("i"))).alias("c")
    return linked.groupBy(*PAGE, F.col("linked_chain").alias("chain_id")).agg(best).select(*PAGE, "chain_id", "c.*")


def _whole(v: Column) -> Column:
    return F.bround(v, 0).cast("long").cast("string")


def _low_conf(conf: Column) -> Column:
    return F.when(conf < 60, F.concat(F.lit("låg OCR-confidence ("), _whole(conf), F.lit(")")))


def vertical_height(system: Column, cfg: Config) -> Column:
    heights = F.create_map(*[F.lit(x) for k, v in cfg.vertical_heights.items() for x in (k, float(v))]) if cfg.vertical_heights else F.create_map().cast("map<string,double>")
    return F.coalesce(F.try_element_at(heights, system), F.lit(float(cfg.vertical_heights.get(UNKNOWN, 2.8))))


def quantity_rows(codes: DataFrame, chains: DataFrame, scale: DataFrame, systems: DataFrame, cfg: Config) -> DataFrame:
    """One row a run, a run's verticals, and a point code; order by (page, part, no) for a bill's order.

    systems: (page, code, system) of base codes.
    """
    s = scale.select(*PAGE, "pts_per_meter")
    known = F.col("pts_per_meter").isNotNull()
    number = F.lit(None).cast("double")
    first = primary_codes(chains, codes)
    by_code = systems.select(*PAGE, F.col("code").alias("base_code"), F.col("system").alias("code_system"))
    runs = chains.filter("not excluded").drop("excluded_reason").join(s, PAGE, "left").join(first, [*PAGE, "chain_id"], "left")
    runs = runs.join(by_code, [*PAGE, "base_code"], "left")
    labelled = F.col("full_code").isNotNull()
    subject = F.when(labelled, F.col("full_code")).otherwise(F.coalesce(F.concat("system", F.lit(UNLABELLED)), F.lit(UNLINKED)))
    lager = F.coalesce("system", F.when(labelled, F.col("code_system")), F.lit(UNKNOWN))
    length = F.when(known, F.col("length_pt") / F.col("pts_per_meter")).otherwise(F.col("length_pt"))
    several = labelled & (F.col("count") > 1)
    if cfg.nx_multiplies_length:
        length = F.when(several, length * F.col("count")).otherwise(length)
    nx = F.concat(F.col("count").cast("string"), F.lit(" parallella rör ("), F.col("raw_text"), F.lit("), längden multiplicerad" if cfg.nx_multiplies_length else ") – ritade var för sig, längden ej multiplicerad"))
    unscaled = F.when(~known, F.lit(FLAG_POINTS))
    flags = F.when(labelled, F.concat_ws("; ", unscaled, F.when(several, nx), _low_conf(F.col("conf")))).otherwise(F.concat_ws("; ", F.lit(FLAG_UNLINKED), unscaled))
    source = F.concat(F.lit("chain:"), F.col("chain_id").cast("string"))
    runs = runs.withColumns({"_subject": subject, "_lager": lager})
    pipe = runs.select(*PAGE, F.lit(0).alias("part"), (F.col("chain_id") * 2).alias("no"), F.col("_subject").alias("subject"), F.col("_lager").alias("lager"), length.alias("langd_m"), F.lit(None).cast("long").alias("antal"), F.lit(None).cast("long").alias("antal_vs"), number.alias("vertikal_hojd_m"), number.alias("total_vertikalhojd_m"), source.alias("kalla"), flags.alias("kommentar"))
    drops = runs.filter(labelled & (F.col("vertical_symbols") > 0))
    n_vs, high = (F.col("vertical_symbols") * F.col("count")).cast("long"), vertical_height(F.col("_lager"), cfg)
    assumed = F.concat(F.lit("vertikalhöjd "), high.cast("string"), F.lit(" m är ett ANTAGANDE (konfig), inte uppmätt"))
    vertical = drops.select(*PAGE, F.lit(0).alias("part"), (F.col("chain_id") * 2 + 1).alias("no"), F.concat("_subject", F.lit(VERTICAL)).alias("subject"), F.col("_lager").alias("lager"), number.alias("langd_m"), F.lit(None).cast("long").alias("antal"), n_vs.alias("antal_vs"), high.alias("vertikal_hojd_m"), (n_vs * high).alias("total_vertikalhojd_m"), source.alias("kalla"), assumed.alias("kommentar"))
    box = Box.of()
    points = codes.filter(~F.col("excluded") & F.col("linked_chain").isNull()).join(by_code, [*PAGE, "base_code"], "left")
    place = F.concat(F.lit("code:"), F.col("code_id").cast("string"), F.lit("@("), _whole(box.cx), F.lit(","), _whole(box.cy), F.lit(")"))
    point = points.select(*PAGE, F.lit(1).alias("part"), F.col("code_id").alias("no"), F.col("full_code").alias("subject"), F.coalesce("code_system", F.lit(UNKNOWN)).alias("lager"), number.alias("langd_m"), F.col("count").cast("long").alias("antal"), F.lit(None).cast("long").alias("antal_vs"), number.alias("vertikal_hojd_m"), number.alias("total_vertikalhojd_m"), place.alias("kalla"), F.concat_ws("; ", F.lit(FLAG_COMPONENT), _low_conf(F.col("conf"))).alias("kommentar"))
    rows = pipe.unionByName(vertical).unionByName(point).withColumn("color", color_for_code(F.col("subject")))
    return rows.withColumns({"langd_m": round_exact(F.col("langd_m"), 2), "total_vertikalhojd_m": round_exact(F.col("total_vertikalhojd_m"), 2), "document": F.lit(""), "sidetikett": F.lit("")})


def summarise(rows: DataFrame) -> DataFrame:
    """(page, subject, lager, color, n_strackor, total_langd_m, n_punkter, antal_vs, total_vertikalhojd_m, flaggor)."""
    at = F.struct("part", "no")
    run = F.col("antal").isNull() & F.col("langd_m").isNotNull()
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(F.coalesce("kommentar", F.lit("")), "; "), lambda f: f != "")))))
    out = rows.groupBy(*PAGE, "subject").agg(
        F.min_by("lager", at).alias("lager"),
        F.min_by("color", at).alias("color"),
        F.count_if(run).alias("n_strackor"),
        F.coalesce(F.sum(F.when(run, F.col("langd_m"))), F.lit(0.0)).alias("total_langd_m"),
        F.coalesce(F.sum("antal"), F.lit(0)).alias("n_punkter"),
        F.coalesce(F.sum("antal_vs"), F.lit(0)).alias("antal_vs"),
        F.coalesce(F.sum(F.when(F.col("antal_vs") > 0, F.col("total_vertikalhojd_m"))), F.lit(0.0)).alias("total_vertikalhojd_m"),
        flags.alias("flaggor"),
    )
    return out.withColumns({c: round_exact(F.col(c), 2) for c in ("total_langd_m", "total_vertikalhojd_m")})


def count_checks(summary: DataFrame, expected: DataFrame) -> DataFrame:
    """(page, code, expected, found, ok, message): the legend's counts against the points of a code, of longer codes with a
    '-' behind it, and of codes that it begins with."""
    own = summary.select(*PAGE, "subject", "n_punkter")
    hit = (F.col("subject") == F.col("code")) | F.startswith("subject", F.concat("code", F.lit("-"))) | F.startswith("code", "subject")
    pairs = expected.join(own, PAGE, "left").groupBy(*PAGE, "code", "expected").agg(F.coalesce(F.sum(F.when(hit, F.col("n_punkter"))), F.lit(0)).alias("found"))
    ok = F.col("found") == F.col("expected")
    said = F.format_string("%s: legend anger %d st, hittade %d st på ritningsytan [%s]", "code", "expected", "found", F.when(ok, "OK").otherwise("AVVIKELSE"))
    return pairs.withColumns({"ok": ok, "message": said})


def warnings(scale: DataFrame, rows: DataFrame, checks: DataFrame) -> DataFrame:
    """(page, rank, no, message), in order: the scale's, no scale, assumed heights once, counts that differ, and OCR."""
    own = scale.select(*PAGE, F.posexplode("warnings").alias("no", "message")).withColumn("rank", F.lit(0))
    none = scale.filter(F.col("pts_per_meter").isNull()).select(*PAGE, F.lit(0).alias("no"), F.lit(WARN_NO_SCALE).alias("message"), F.lit(1).alias("rank"))
    high = rows.filter(F.col("antal_vs").isNotNull()).select(*PAGE).distinct().select(*PAGE, F.lit(0).alias("no"), F.lit(WARN_VERTICAL).alias("message"), F.lit(2).alias("rank"))
    differ = checks.filter("not ok").select(*PAGE, F.lit(0).alias("no"), F.concat(F.lit(COUNT_CHECK), "message").alias("message"), F.lit(3).alias("rank"))
    ocr = scale.select(*PAGE, F.lit(0).alias("no"), F.lit(WARN_OCR).alias("message"), F.lit(4).alias("rank"))
    out = own.select(*PAGE, "rank", "no", "message")
    for part in (none, high, differ, ocr):
        out = out.unionByName(part.select(*PAGE, "rank", "no", "message"))
    return out


def run_summary(codes: DataFrame, chains: DataFrame, rows: DataFrame) -> DataFrame:
    """(page, n_codes, n_codes_linked, n_chains, n_chains_linked, n_rows, n_unique_codes)."""
    linked = codes.filter(F.col("linked_chain").isNotNull()).select(*PAGE, F.col("linked_chain").alias("chain_id")).distinct().withColumn("_l", F.lit(True))
    c = codes.groupBy(*PAGE).agg(F.count_if(~F.col("excluded")).alias("n_codes"), F.count_if(~F.col("excluded") & F.col("linked_chain").isNotNull()).alias("n_codes_linked"))
    h = chains.join(linked, [*PAGE, "chain_id"], "left").groupBy(*PAGE).agg(F.count_if(~F.col("excluded")).alias("n_chains"), F.count_if(~F.col("excluded") & F.col("_l").isNotNull()).alias("n_chains_linked"))
    r = rows.groupBy(*PAGE).agg(F.count("*").alias("n_rows"), F.countDistinct("subject").alias("n_unique_codes"))
    return c.join(h, PAGE, "full").join(r, PAGE, "full").na.fill(0)


def top_layers(lengths: DataFrame, most: int = 60) -> DataFrame:
    """A page's longest named layers: the report of layers shows `most` of them."""
    from pyspark.sql import Window

    from quantspark.functions import layers as L

    w = Window.partitionBy(*PAGE).orderBy(F.desc("length"), "layer")
    ranked = lengths.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.withColumns({"name": L.layer_name(F.col("layer")), "is_pipe": L.is_pipe_layer(F.col("layer")), "system": L.system_for_layer(F.col("layer"))})

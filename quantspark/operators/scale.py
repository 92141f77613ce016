"""The scale of each page: given, else read from the title block, else measured on a scale bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.config import MM_IN_POINT, Config, parse_scale
from quantspark.functions.geometry import Box

from .grid import PAGE

# Usual scales, and the texts of results.
COMMON = (20, 25, 50, 100, 200, 250, 400, 500, 1000, 2000)
NO_SCALE = "Ingen skala kunde läsas ur titelblock eller skalstock – längder redovisas i PDF-punkter. Ange skala med --scale."
_TEXT = r"\b1\s*[:;]\s*(\d{1,4})\b"


def scale_candidates(hits: DataFrame, reach: float = 150.0) -> DataFrame:
    """(page, n, near): each 1:N of a hit's text, and whether the hit's centre is near a hit that says SKALA."""
    box = Box.of()
    found = hits.withColumn("n", F.explode(F.regexp_extract_all("text", F.lit(_TEXT), F.lit(1)))).withColumn("n", F.col("n").try_cast("int"))
    found = found.filter(F.col("n").between(1, 2000)).select(*PAGE, "n", box.cx.alias("mx"), box.cy.alias("my"))
    words = hits.filter(F.contains(F.upper("text"), F.lit("SKALA"))).groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_s"))
    near = F.exists("_s", lambda b: F.col("mx").between(b["x0"] - reach, b["x1"] + reach) & F.col("my").between(b["y0"] - reach, b["y1"] + reach))
    return found.join(words, PAGE, "left").select(*PAGE, "n", F.coalesce(near, F.lit(False)).alias("near"))


def title_scale(hits: DataFrame) -> DataFrame:
    """(page, n): near readings if there are any; a reading that a longer one begins with is that one cut off; then the
    least usual scale, else the least."""
    c = scale_candidates(hits)
    pool = c.withColumn("_any", F.max("near").over(Window.partitionBy(*PAGE))).filter(F.col("near") | ~F.col("_any"))
    values = pool.groupBy(*PAGE).agg(F.collect_set("n").alias("v"))
    longer = lambda n: F.array_max(F.filter("v", lambda m: (m != n) & F.startswith(m.cast("string"), n.cast("string"))))
    whole = F.transform("v", lambda n: F.coalesce(longer(n), n))
    usual = F.filter(whole, lambda n: n.isin(*COMMON))
    return values.select(*PAGE, F.coalesce(F.array_min(usual), F.array_min(whole)).alias("n"))


def bar_scale(hits: DataFrame) -> DataFrame:
    """(page, bar_ppm): numbers 0, 1, 2, ... in a row with even gaps and an 'm' behind; the longest bar's points per metre.

    Of hits with one number in a row the last by hit_seq counts.
    """
    box = Box.of()
    place = [*PAGE, "hit_seq", box.cx.alias("mx"), box.cy.alias("my")]
    digits = hits.filter(F.col("text").rlike(r"^[0-9]{1,2}$")).select(*place, F.col("text").try_cast("int").alias("v"), F.col("text").alias("digits"))
    units = hits.filter(F.lower("text").isin("m", "meter")).groupBy(*PAGE).agg(F.collect_list(F.struct(box.cx.alias("x"), box.cy.alias("y"))).alias("_m"))
    zero = digits.filter("digits = '0'").select(*PAGE, F.col("hit_seq").alias("zero"), F.col("mx").alias("zx"), F.col("my").alias("zy"))
    row = zero.join(digits, PAGE).filter((F.abs(F.col("my") - F.col("zy")) < 6) & (F.col("mx") >= F.col("zx")))
    last = row.groupBy(*PAGE, "zero", "zx", "zy", "v").agg(F.max_by("mx", "hit_seq").alias("x"))
    w = Window.partitionBy(*PAGE, "zero").orderBy("v")
    run = last.withColumn("_i", F.row_number().over(w) - 1).filter("_i = v").withColumn("gap", F.col("x") - F.lag("x").over(w))
    bars = run.groupBy(*PAGE, "zero", "zy").agg(F.count("*").alias("k"), F.max("v").alias("meters"), F.max_by("x", "v").alias("end"), F.min_by("x", "v").alias("begin"), F.collect_list("gap").alias("gaps"))
    mean = F.try_divide(F.aggregate("gaps", F.lit(0.0), lambda a, g: a + g), F.size("gaps"))
    bars = bars.withColumn("_mean", mean).filter((F.col("k") >= 3) & (F.col("_mean") > 0))
    bars = bars.filter(F.forall("gaps", lambda g: F.abs(g - F.col("_mean")) <= 0.25 * F.col("_mean")))
    unit = F.exists("_m", lambda m: (F.abs(m["y"] - F.col("zy")) < 8) & (m["x"] - F.col("end") > 0) & (m["x"] - F.col("end") < 60))
    bars = bars.join(units, PAGE).filter(unit)
    return bars.groupBy(*PAGE).agg(F.max_by((F.col("end") - F.col("begin")) / F.col("meters"), F.struct("meters", -F.col("zero"))).alias("bar_ppm"))


def determine_scale(pages: DataFrame, hits: DataFrame, cfg: Config) -> DataFrame:
    """(page, pts_per_meter, method, scale_text, title_ppm, bar_ppm, warnings)."""
    texts, nothing = F.array().cast("array<string>"), F.lit(None).cast("double")
    if cfg.scale:
        given = F.lit(parse_scale(cfg.scale))
        return pages.select(*PAGE, given.alias("pts_per_meter"), F.lit("cli").alias("method"), F.lit(cfg.scale).alias("scale_text"), nothing.alias("title_ppm"), nothing.alias("bar_ppm"), texts.alias("warnings"))
    both = pages.select(*PAGE).join(title_scale(hits), PAGE, "left").join(bar_scale(hits), PAGE, "left")
    both = both.withColumn("title_ppm", 1000.0 / F.col("n") / F.lit(MM_IN_POINT)).withColumn("scale_text", F.when(F.col("n").isNotNull(), F.concat(F.lit("1:"), F.col("n").cast("string"))))
    rel = F.abs(F.col("title_ppm") - F.col("bar_ppm")) / F.col("title_ppm")
    differ = F.format_string("Titelblock (%s = %.2f pt/m) och skalstock (%.2f pt/m) ger olika svar (%.0f %% skillnad) – verifiera skalan manuellt!", "scale_text", "title_ppm", "bar_ppm", rel * 100)
    method = F.when(F.col("title_ppm").isNotNull(), "titelblock").when(F.col("bar_ppm").isNotNull(), "skalstock").otherwise("okänd")
    said = F.when(rel > 0.05, F.array(differ)).when(method == "okänd", F.array(F.lit(NO_SCALE))).otherwise(texts)
    return both.select(*PAGE, F.coalesce("title_ppm", "bar_ppm").alias("pts_per_meter"), method.alias("method"), "scale_text", "title_ppm", "bar_ppm", said.alias("warnings"))

"""The legend: text lines, system headers, the systems of code prefixes, expected counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.config import HEAT, SEWER, UNKNOWN, WATER, Config
from quantspark.functions import codes as C

from .grid import PAGE

# The words of headers.
SYSTEM_WORDS = {"TAPPVATTEN": WATER, "SPILLVATTEN": SEWER, "DAGVATTEN": SEWER, "VÄRME": HEAT, "VARME": HEAT}
LEGEND_WORDS = ("FÖRKLARINGAR", "FORKLARINGAR")
_LINE = "line_no long, text string, x0 double, y0 double, x1 double, y1 double"


def text_lines(hits: DataFrame, height: float = 0.6, gap: float = 40.0) -> DataFrame:
    """(page, line_no, text, box): words of one height, each at most `gap` right of the one before, joined by spaces.

    A word goes to the first line that takes it, in order of (y0, x0), so a page is one task's work; lines are kept by the
    height of their last word, so a word sees those beside it alone.
    """

    def run(words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values(["y0", "x0", "hit_seq"], kind="stable").reset_index(drop=True)
        x0, x1 = words["x0"].to_numpy(), words["x1"].to_numpy()
        tall, middle = (words["y1"] - words["y0"]).to_numpy(), ((words["y0"] + words["y1"]) / 2).to_numpy()
        # lines by the band of their last word: words of one level are in one band or two that are next to each other
        reach = max(height * float(tall.max()), 1e-9)
        band = np.floor(middle / reach).astype(np.int64)
        open_in: dict[int, set[int]] = {}
        last: list[int] = []
        line_of = np.empty(len(words), np.int64)
        for i, b in enumerate(band.tolist()):
            found = [(line, last[line]) for near in (b - 1, b, b + 1) for line in open_in.get(near, ())]
            takes = [line for line, w in found if abs(middle[i] - middle[w]) < height * max(tall[i], tall[w]) and 0 <= x0[i] - x1[w] < gap]
            line = min(takes, default=len(last))
            if takes:
                open_in[band[last[line]]].discard(line)
                last[line] = i
            else:
                last.append(i)
            open_in.setdefault(b, set()).add(line)
            line_of[i] = line
        out = words.assign(line_no=line_of).groupby("line_no", sort=True).agg(text=("text", " ".join), x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max"))
        return out.reset_index().assign(**{c: words[c].iloc[0] for c in PAGE})[[*PAGE, "line_no", "text", "x0", "y0", "x1", "y1"]]

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    return hits.select(*PAGE, "hit_seq", "text", "x0", "y0", "x1", "y1").groupBy(*PAGE).applyInPandas(run, f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, {_LINE}")


def legend_box(lines: DataFrame) -> DataFrame:
    """(page, box) of the first line that heads a legend."""
    up = F.upper("text")
    found = lines.filter(F.contains(up, F.lit(LEGEND_WORDS[0])) | F.contains(up, F.lit(LEGEND_WORDS[1])))
    return found.groupBy(*PAGE).agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "line_no").alias("b")).select(*PAGE, "b.*")


def headers(lines: DataFrame) -> DataFrame:
    """(page, system, box, until): system headers in order of height, each until the next, the last for 400 points."""
    up = F.upper("text")
    system = F.coalesce(*[F.when(F.contains(up, F.lit(word)), F.lit(name)) for word, name in SYSTEM_WORDS.items()])
    found = lines.filter(F.contains(up, F.lit("SYSTEM")) & system.isNotNull()).withColumn("system", system)
    w = Window.partitionBy(*PAGE).orderBy("y0", "line_no")
    return found.select(*PAGE, "system", "x0", "y1", F.row_number().over(w).alias("rank"), F.coalesce(F.lead("y0").over(w), F.col("y1") + 400.0).alias("until"))


def first_word(text: str) -> Column:
    return F.split_part(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(" "), F.lit(1))


def prefix_map(lines: DataFrame, cfg: Config) -> DataFrame:
    """(page, prefix, system): codes under a header, in its column, have its system. For a full prefix the last line
    counts, for a letter prefix the first, and a full prefix goes before a letter prefix of the same text unless that came first."""
    h = headers(lines).withColumnsRenamed({"x0": "_hx", "y1": "_hy"})
    under = (F.col("y0") > F.col("_hy") - 2) & (F.col("y0") < F.col("until")) & (F.abs(F.col("x0") - F.col("_hx")) <= 120)
    codes = lines.join(h, PAGE).filter(under).withColumn("code", first_word("text")).filter(C.is_code(F.col("code"), cfg.code_regex))
    at = F.struct("rank", "line_no")
    full = codes.select(*PAGE, C.full_prefix(F.col("code")).alias("prefix"), "system", at.alias("at"), F.lit(1).alias("full"))
    letters = codes.select(*PAGE, C.letter_prefix(F.col("code")).alias("prefix"), "system", at.alias("at"), F.lit(0).alias("full"))
    both = full.unionByName(letters).groupBy(*PAGE, "prefix")
    last_full = F.max_by("system", F.when(F.col("full") == 1, F.col("at")))
    first_letter = F.min_by("system", F.when(F.col("full") == 0, F.col("at")))
    return both.agg(F.coalesce(F.when(F.max("full") == 1, last_full), first_letter).alias("system"))


def expected_counts(lines: DataFrame, cfg: Config) -> DataFrame:
    """(page, code, expected): lines that begin with a code and say 'N st'; the last line of a code counts."""
    # Fixed value: the pattern of a count.
    n = F.regexp_extract("text", r"(?i)\(?\s*(\d+)\s*st\s*\)?", 1)
    rows = lines.withColumns({"code": first_word("text"), "expected": F.nullif(n, F.lit("")).cast("long")})
    rows = rows.filter(C.is_code(F.col("code"), cfg.code_regex) & F.col("expected").isNotNull())
    return rows.groupBy(*PAGE, "code").agg(F.max_by("expected", "line_no").alias("expected"))


def legend_zone(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, box) of the zone under a legend's heading: codes in it are the legend's own."""
    return legend_box(lines).join(pages, PAGE).select(*PAGE, (F.col("x0") - 10).alias("x0"), (F.col("y0") - 5).alias("y0"), (F.col("x0") + 260).alias("x1"), F.col("height").alias("y1"))


def systems_of_codes(codes: DataFrame, prefixes: DataFrame, cfg: Config, code_col: str = "base_code") -> DataFrame:
    """(page, code, system) of different codes: the page's legend, then the configured prefixes; in each an exact full
    prefix, an exact letter prefix, the longest that the code begins with; else unknown."""
    code = F.col("code")
    own = codes.select(*PAGE, F.col(code_col).alias("code")).distinct()
    legend = prefixes.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("prefix", "system"))).alias("_map"))
    fixed = F.create_map(*[F.lit(x) for kv in cfg.system_prefixes.items() for x in kv]) if cfg.system_prefixes else F.create_map().cast("map<string,string>")

    def looked_up(m: Column) -> Column:
        begins = F.filter(F.map_keys(m), lambda k: F.startswith(code, k) & (k != ""))
        longest = F.element_at(F.array_sort(F.transform(begins, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), 1)
        longest = F.when(F.size(begins) > 0, longest["k"])
        at = lambda k: F.try_element_at(m, k)
        return F.coalesce(at(C.full_prefix(code)), at(C.letter_prefix(code)), F.when(longest.isNotNull(), at(longest)))

    return own.join(legend, PAGE, "left").select(*PAGE, "code", F.coalesce(looked_up(F.col("_map")), looked_up(fixed), F.lit(UNKNOWN)).alias("system"))

"""Reconciliation with a ground-truth bill ("facit")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.functions import numbers as N

_COUNTS = ("n_rows", "n_length_rows", "n_points", "n_vertical_rows", "antal_vs")


def _cell(df: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def read_facit(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, subject, counts, total_length, lager) of bill rows as text; rows without a subject are left out.

    A row with a length is a run, else one with a count of verticals a vertical, else a point. `row_no`, if there is one,
    says which row's lager comes first.
    """
    if "Subject" not in rows.columns:
        raise ValueError(f"Facit-filen saknar 'Subject'-kolumn (kolumner: {rows.columns})")
    length = N.to_number(F.coalesce(F.nullif(_cell(rows, "Längd"), F.lit("")), _cell(rows, "Langd")))
    vs = N.to_whole(_cell(rows, "Antal_VS"))
    order = F.col("row_no") if "row_no" in rows.columns else F.lit(0)
    t = rows.select(*by, _cell(rows, "Subject").alias("subject"), length.alias("len"), vs.alias("vs"), F.nullif(_cell(rows, "Lager"), F.lit("")).alias("lg"), order.alias("at")).filter("subject <> ''")
    vertical = F.col("len").isNull() & (F.coalesce("vs", F.lit(0)) != 0)
    return t.groupBy(*by, "subject").agg(
        F.count("*").alias("n_rows"),
        F.count("len").alias("n_length_rows"),
        F.coalesce(F.sum("len"), F.lit(0.0)).alias("total_length"),
        F.count_if(F.col("len").isNull() & ~vertical).alias("n_points"),
        F.count_if(vertical).alias("n_vertical_rows"),
        F.coalesce(F.sum("vs"), F.lit(0)).alias("antal_vs"),
        F.coalesce(F.min_by("lg", F.when(F.col("lg").isNotNull(), F.col("at"))), F.lit("")).alias("lager"),
    )


def reconcile(ours: DataFrame, facit: DataFrame, by: tuple[str, ...] = (), tol_pct: float = 5.0) -> DataFrame:
    """Full outer join on the subject, with `status`: 'ok', 'deviates', 'missing' (not ours), 'extra' (not in the bill).

    Lengths agree within tol_pct; where the bill has none, the numbers of runs must; points must agree exactly; verticals
    are only reported.
    """
    o = ours.select(*by, "subject", F.col("n_strackor").alias("our_runs"), F.col("total_langd_m").alias("our_length"), F.col("n_punkter").alias("our_points"), F.col("antal_vs").alias("our_verticals"))
    f = facit.select(*by, "subject", F.col("n_length_rows").alias("facit_runs"), F.col("total_length").alias("facit_length"), F.col("n_points").alias("facit_points"), F.col("antal_vs").alias("facit_verticals"))
    both = f.join(o, [*by, "subject"], "full")
    pct = F.when(F.col("facit_length") > 0, (F.col("our_length") - F.col("facit_length")) / F.nullif(F.col("facit_length"), F.lit(0.0)) * 100.0)
    lengths = F.when(F.col("facit_length") > 0, F.abs(pct) <= tol_pct).otherwise(F.col("our_runs") == F.col("facit_runs"))
    status = F.when(F.col("facit_runs").isNull(), "extra").when(F.col("our_runs").isNull(), "missing").when(lengths & (F.col("our_points") == F.col("facit_points")), "ok").otherwise("deviates")
    return both.withColumns({"diff_pct": pct, "status": status})


def report_lines(reconciled: DataFrame, tol_pct: float = 5.0) -> list[str]:
    """The report's text for one bill, from the few rows that a bill has."""
    num = lambda v: f"{v:.1f}".replace(".", ",")
    rows = sorted(reconciled.collect(), key=lambda r: r["subject"])
    lines, ok = ["VALIDERING MOT FACIT", "=" * 60], 0
    compared = [r for r in rows if r["status"] != "extra"]
    for r in compared:
        head = f"{r['subject']}: facit {r['facit_runs']} sträckor / {num(r['facit_length'])} m totalt"
        if r["status"] == "missing":
            lines.append(f"{head} ({r['facit_points']} punkter), vårt resultat SAKNAS helt")
            continue
        parts = [head, f"vårt resultat {r['our_runs']} sträckor / {num(r['our_length'])} m totalt"]
        if r["diff_pct"] is not None:
            parts.append(f"{r['diff_pct']:+.0f} %")
        if r["facit_points"] or r["our_points"]:
            parts.append(f"punkter: facit {r['facit_points']} / vårt {r['our_points']}")
        if r["facit_verticals"] or r["our_verticals"]:
            parts.append(f"vertikaler: facit {r['facit_verticals']} / vårt {r['our_verticals']}")
        ok += r["status"] == "ok"
        lines.append(", ".join(parts) + ("" if r["status"] == "ok" else "  [AVVIKELSE]"))
    if extra := [r for r in rows if r["status"] == "extra"]:
        lines += ["", "Koder hos oss som saknas i facit (möjliga OCR-feltolkningar eller legendtext):"]
        lines += [f"  {r['subject']}: {r['our_runs']} sträckor / {num(r['our_length'])} m, {r['our_points']} punkter" for r in extra]
    return [*lines, "", f"Sammanfattning: {ok}/{len(compared)} koder inom tolerans (±{tol_pct:.0f} % längd, exakt antal punkter)"]

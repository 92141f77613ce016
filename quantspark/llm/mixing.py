"""Mixing sources to target weights by iterative proportional fitting.

Documents are aggregated to cells of source, language and topic with their
token totals. The cells' weights are raked: scaled by source, then language,
then topic, again and again, until each marginal has its target share. A
document is then kept with its cell's probability: the raked weight over the
weight it has, scaled so that the kept tokens make up `budget` of all, and
never over 1 (what a full cell cannot give, the others do). Whether a document
is kept follows from a hash of its id alone, so a retried task decides alike.

A marginal with targets keeps the values that they name and puts all others
together as "*"; one without targets keeps every value it has, each with a
target of its own. Up to MOST_CELLS cells are raked on the driver. More are
raked where they lie, a row for each source: for given factors of languages
and topics a source's factor follows from its own cells alone, so a round is
one pass over the rows, and only sums by language and topic come to the driver.
Both ways do the same steps and end by the same rule. Languages and topics are
taken to be few enough for the driver, sources are not.

Null sources, languages and texts count as the values "" and the empty text.
A target without documents is passed over and the rest are scaled to 1. Rows
that repeat a doc_id get one decision. A null doc_id hashes as such. Empty
tables give empty results. Other columns are not touched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MOST_CELLS, ROUNDS, CLOSE, SEED = 50_000, 200, 1e-10, 17
#: Share of all tokens that is kept, and how far targets go from the shares found (0) to equal shares (1).
BUDGET, FLATTEN = 0.8, 0.5
OTHER = "*"
_MARGINALS = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    """Words between white space, the weight of a document."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by form: tables, lists of figures, shouting, short notes, prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1))
    bars = F.char_length(t) - F.char_length(F.replace(t, F.lit("|"), F.lit("")))
    digits = F.char_length(t) - F.char_length(F.regexp_replace(t, "[0-9]", ""))
    same = F.when(F.upper(F.substring(t, 1, 200)) == F.substring(t, 1, 200), F.upper(t) == t).otherwise(F.lit(False))
    return F.when(bars * 50 > n, "table").when(digits * 10 > n, "figures").when(same, "capitals").when(n < 500, "note").otherwise("prose")


@dataclass(frozen=True)
class Mix:
    """Probability of each cell (source, lang, topic); named: the values that a marginal with targets keeps.

    table: (_source, _lang, _topic, weight, probability) of the cells where they are too many for the driver.
    """

    cells: dict[tuple[str, str, str], float]
    weights: dict[tuple[str, str, str], float]
    named: dict[str, list[str]]
    table: DataFrame | None = None


def rake(totals: dict[tuple[str, ...], float], targets: list[dict[str, float]], rounds: int = ROUNDS, close: float = CLOSE) -> dict[tuple[str, ...], float]:
    """Weights of cells, summing to 1, whose marginals are the targets. Values without tokens are passed over."""
    cells = sorted(c for c, t in totals.items() if t > 0)
    if not cells:
        return {}
    w = np.array([totals[c] for c in cells], float)
    w /= w.sum()
    index = []
    for d, target in enumerate(targets):
        values = sorted({c[d] for c in cells})
        goal = np.array([max(0.0, target.get(v, 0.0)) for v in values])
        index.append((np.array([values.index(c[d]) for c in cells]), goal / goal.sum() if goal.sum() > 0 else None, len(values)))
    for _ in range(rounds):
        before = w.copy()
        for at, goal, n in index:
            if goal is not None:
                have = np.bincount(at, w, n)
                w = w * np.divide(goal, have, out=np.zeros(n), where=have > 0)[at]
                w /= w.sum() or 1.0
        if np.abs(w - before).max() < close:
            break
    return dict(zip(cells, w.tolist(), strict=True))


def probabilities(totals: dict[tuple[str, ...], float], weights: dict[tuple[str, ...], float], budget: float) -> dict[tuple[str, ...], float]:
    """Chance of each cell's documents, so that budget * all tokens are kept in the weights' proportion; 1 at most."""
    cells = sorted(weights)
    have = np.array([totals[c] for c in cells])
    want = np.array([weights[c] for c in cells])
    goal, full = budget * sum(totals.values()), np.zeros(len(cells), bool)
    p = np.zeros(len(cells))
    while len(cells):
        rest = goal - have[full].sum()
        open_ = ~full & (want > 0)
        p[full] = 1.0
        if not open_.any() or rest <= 0:
            break
        p[open_] = want[open_] / want[open_].sum() * rest / have[open_]
        over = open_ & (p >= 1)
        if not over.any():
            break
        full |= over
    return dict(zip(cells, np.minimum(p, 1.0).tolist(), strict=True))


def flattened(totals: dict[tuple[str, ...], float], d: int, flatten: float) -> dict[str, float]:
    """Targets between the shares found and equal shares."""
    sums: dict[str, float] = {}
    for cell, t in totals.items():
        sums[cell[d]] = sums.get(cell[d], 0.0) + t
    sums = {v: s for v, s in sums.items() if s > 0}
    whole = sum(sums.values()) or 1.0
    return {v: (1 - flatten) * s / whole + flatten / len(sums) for v, s in sums.items()}


def _cells(docs: DataFrame, source_col: str, lang_col: str, text_col: str, named: dict[str, list[str]]) -> dict[str, Column]:
    value = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    out = {"source": value(source_col), "lang": value(lang_col), "topic": topic(docs[text_col])}
    return {k: F.when(c.isin(named[k]), c).otherwise(OTHER) if named.get(k) else c for k, c in out.items()}


def fit(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, flatten: float = FLATTEN, source_col: str = "source", lang_col: str = "lang", text_col: str = "text", most_cells: int = MOST_CELLS) -> Mix:
    """targets: shares by marginal (source, lang, topic); a marginal without them goes towards equal shares by `flatten`."""
    targets = targets or {}
    named = {m: sorted(targets[m]) for m in _MARGINALS if m in targets}
    cell = _cells(docs, source_col, lang_col, text_col, named)
    weighed = docs.select(*[c.alias(m) for m, c in cell.items()], tokens(docs[text_col]).alias("n"))
    by_cell = common.stored(weighed.groupBy(*_MARGINALS).agg(F.sum("n").alias("n")), "mixing-cells")
    if by_cell.count() > most_cells:
        return Mix({}, {}, named, _fit_rows(by_cell, targets, budget, flatten))
    totals = {tuple(r[m] for m in _MARGINALS): float(r["n"] or 0) for r in by_cell.collect()}
    weights = rake(totals, [targets.get(m) or flattened(totals, d, flatten) for d, m in enumerate(_MARGINALS)])
    chance = probabilities(totals, weights, budget)
    return Mix({c: chance.get(c, 1.0) for c in totals}, weights, named)


def _factors(source: np.ndarray, goal: np.ndarray | None, n: np.ndarray, pair: np.ndarray, q: np.ndarray | None, whole: float) -> np.ndarray:
    """Each source's factor after its step, for factors q of (language, topic); without q or goal: of the shares found."""
    if q is None or goal is None:
        return np.full(int(source[-1]) + 1, 1 / whole)
    have = np.bincount(source, n * q[pair])
    return np.divide(goal, have, out=np.zeros(len(have)), where=have > 0)


def _rows_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(source, pair, n, goal): the cells of a batch of sources, by place of their source in it."""
    pairs = b.column(b.schema.get_field_index("pairs"))
    source = np.repeat(np.arange(b.num_rows), np.diff(pairs.offsets.to_numpy()))
    n = b.column(b.schema.get_field_index("ns")).flatten().to_numpy()
    return source, pairs.flatten().to_numpy(), n, b.column(b.schema.get_field_index("goal")).to_numpy()


def _fit_rows(by_cell: DataFrame, targets: dict[str, dict[str, float]], budget: float, flatten: float) -> DataFrame:
    """`rake` and `probabilities` for any number of sources: Mix.table."""
    spark, some = by_cell.sparkSession, by_cell.filter("n > 0")
    found = [(r["lang"], r["topic"], float(r["n"])) for r in some.groupBy("lang", "topic").agg(F.sum("n").alias("n")).orderBy("lang", "topic").collect()]
    nothing = by_cell.filter("n = 0").select(*[F.col(m).alias(f"_{m}") for m in _MARGINALS], F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    if not found:
        return nothing
    whole = sum(n for _, _, n in found)
    names = spark.createDataFrame([(t, p, i) for i, (t, p, _) in enumerate(found)], "_lang string, _topic string, pair int")
    rows = some.join(F.broadcast(names), (F.col("lang") == F.col("_lang")) & (F.col("topic") == F.col("_topic")))
    cells = F.collect_list(F.struct("pair", F.col("n").cast("double").alias("n"))).alias("cells")
    rows = rows.groupBy("source").agg(F.sum("n").alias("own"), F.sort_array(cells).alias("cells"))
    rows = common.stored(rows.select("source", "own", F.col("cells.pair").alias("pairs"), F.col("cells.n").alias("ns")), "mixing-sources")
    fixed = True
    if targets.get("source"):
        wanted = spark.createDataFrame([(v, max(0.0, float(g))) for v, g in targets["source"].items()], "_source string, share double")
        rows = rows.join(wanted, F.col("source") == F.col("_source"), "left").withColumn("goal", F.coalesce("share", F.lit(0.0))).drop("_source", "share")
        all_goals = rows.agg(F.sum("goal")).first()[0]
        fixed = all_goals > 0
        rows = common.stored(rows.withColumn("goal", F.col("goal") / (all_goals or 1.0)), "mixing-sources")
    else:
        rows = rows.withColumn("goal", F.lit((1 - flatten) / whole) * F.col("own") + F.lit(flatten / rows.count()))
    rows = rows.select("source", "pairs", "ns", "goal")

    # languages and topics: their steps need sums by pair alone
    steps = []
    for d, m in enumerate(("lang", "topic")):
        values = sorted({x[d] for x in found})
        goal = targets.get(m) or flattened({x[:2]: x[2] for x in found}, d, flatten)
        goal = np.array([max(0.0, goal.get(v, 0.0)) for v in values])
        steps.append((np.array([values.index(x[d]) for x in found]), goal / goal.sum() if goal.sum() > 0 else None, len(values)))

    def sums(q: np.ndarray, q1: np.ndarray | None, q2: np.ndarray | None) -> tuple[np.ndarray, float]:
        """Sums by pair after the sources' step for q; the most that a weight changed from q2, q1 to q1, q."""

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            source, pair, n, goal = _rows_of(b)
            w = n * q[pair] * _factors(source, goal if fixed else None, n, pair, q, whole)[source]
            change = 0.0
            if q1 is not None:
                now = n * q[pair] * _factors(source, goal if fixed else None, n, pair, q1, whole)[source]
                was = n * q1[pair] * _factors(source, goal if fixed else None, n, pair, q2, whole)[source]
                change = float(np.abs(now - was).max())
            at = np.unique(pair)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.bincount(pair, w)[at]), pa.array(np.full(len(at), change))], ["pair", "w", "change"])

        out, most = np.zeros(len(found)), 0.0
        for r in common.by_batch(rows, batch, "pair int, w double, change double").groupBy("pair").agg(F.sum("w").alias("w"), F.max("change").alias("change")).collect():
            out[r["pair"]] = r["w"]
            most = max(most, r["change"])
        return out, most

    q, q1, q2 = np.ones(len(found)), None, None
    for turn in range(ROUNDS):
        by_pair, change = sums(q, q1, q2)
        if turn and change < CLOSE:
            break
        step = np.full(len(found), 1 / (by_pair.sum() or 1.0))
        for at, goal, n in steps:
            if goal is not None:
                have = np.bincount(at, by_pair * step, n)
                step = step * np.divide(goal, have, out=np.zeros(n), where=have > 0)[at]
                step /= (by_pair * step).sum() or 1.0
        q, q1, q2 = q * step, q, q1
    before = q1

    def ratio(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(source, pair, n, weight over n)"""
        source, pair, n, goal = _rows_of(b)
        return source, pair, n, q[pair] * _factors(source, goal if fixed else None, n, pair, before, whole)[source]

    def level(scale: float) -> tuple[float, float, int]:
        """Of the cells that `scale` fills: tokens and number; weight of the others."""

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            _, _, n, r = ratio(b)
            full = (r > 0) & (scale * r >= 1)
            return pa.RecordBatch.from_arrays([pa.array([float(n[full].sum())]), pa.array([float((n * r)[~full].sum())]), pa.array([int(full.sum())], pa.int64())], ["n", "w", "cells"])

        r = common.by_batch(rows, batch, "n double, w double, cells long").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("cells").alias("cells")).first()
        return r["n"], r["w"], r["cells"]

    # full cells stay full as the scale grows, so the scale is all that a round needs to know
    scale, filled = 0.0, -1
    while True:
        n, w, cells = level(scale)
        rest = budget * whole - n
        if cells == filled or rest <= 0 or w <= 0:
            break
        scale, filled = max(scale, rest / w), cells

    def chances(b: pa.RecordBatch) -> pa.RecordBatch:
        source, pair, n, r = ratio(b)
        name = b.column(b.schema.get_field_index("source")).take(pa.array(source))
        return pa.RecordBatch.from_arrays([name, pa.array(pair), pa.array(n * r), pa.array(np.minimum(scale * r, 1.0))], ["_source", "pair", "weight", "probability"])

    out = common.by_batch(rows, chances, "_source string, pair int, weight double, probability double").join(F.broadcast(names), "pair")
    return common.stored(out.select(*[f"_{m}" for m in _MARGINALS], "weight", "probability").unionByName(nothing), "mixing-weights")


def draw(id_col: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 for an id: the first 32 bits of its MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def decided(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(row, source, lang, topic, n_tokens, weight, probability, kept) of each document; cells that the driver holds are broadcast."""
    if mix.table is None:
        schema = ", ".join(f"_{m} string" for m in _MARGINALS) + ", weight double, probability double"
        cells = F.broadcast(docs.sparkSession.createDataFrame([(*c, mix.weights.get(c, 0.0), p) for c, p in sorted(mix.cells.items())], schema))
    else:
        cells = mix.table
    cell = _cells(docs, source_col, lang_col, text_col, mix.named)
    rows = docs.select(common.row_of(docs).alias("row"), *[c.alias(m) for m, c in cell.items()], tokens(docs[text_col]).alias("n_tokens"), draw(docs[id_col], seed).alias("draw"))
    on = [F.col(m) == F.col(f"_{m}") for m in _MARGINALS]
    out = rows.join(cells, on, "left").drop(*[f"_{m}" for m in _MARGINALS])
    return out.withColumn("probability", F.coalesce("probability", F.lit(1.0))).withColumn("kept", F.col("draw") < F.col("probability"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = decided(docs, fit(docs))
    return out.select(F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")

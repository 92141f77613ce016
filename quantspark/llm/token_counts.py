"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; the histogram has one row for
each distinct length, so its size is bounded by the longest text, not by the
corpus. Running sums over it from both ends answer document and token totals,
quantiles, and the tokens that remain when texts are cut at any context limit:

    kept(L) = sum of lengths up to L + L * (documents longer than L)

The sums are taken in blocks of lengths: a window inside each block, and one
over the block totals, so no task holds the whole histogram.

Null and empty texts have length 0 and count as documents. Repeated rows
count once each. An empty table gives an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

#: Lengths in one block of the running sums.
BLOCK = 1024


def histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs) of rows that carry a length; a null length counts as 0."""
    return counted.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def running_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with, for each length taken as a context limit: documents up to it and longer, tokens up to it,
    tokens kept when every text is cut at it, tokens cut off, and the share of documents that fit."""
    h = hist.withColumn("_block", F.floor(F.col("n_tokens") / block)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = h.groupBy("_block").agg(F.sum("n_docs").alias("_bd"), F.sum("_tokens").alias("_bt"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_block",
        F.coalesce(F.sum("_bd").over(before), F.lit(0)).alias("_d0"),
        F.coalesce(F.sum("_bt").over(before), F.lit(0)).alias("_t0"),
        F.sum("_bd").over(everything).alias("_docs"),
        F.sum("_bt").over(everything).alias("_all"),
    )
    inside = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_d", F.sum("n_docs").over(inside)).withColumn("_t", F.sum("_tokens").over(inside)).join(totals, "_block")
    fit, tokens = F.col("_d0") + F.col("_d"), F.col("_t0") + F.col("_t")
    kept = tokens + F.col("n_tokens") * (F.col("_docs") - fit)
    return h.select(
        "n_tokens",
        "n_docs",
        fit.alias("docs_fitting"),
        (F.col("_docs") - fit).alias("docs_longer"),
        tokens.alias("tokens_fitting"),
        (F.col("_all") - tokens).alias("tokens_longer"),
        kept.alias("tokens_kept"),
        (F.col("_all") - kept).alias("tokens_cut"),
        (fit / F.col("_docs")).alias("share_fitting"),
    )


def at_limit(sums: DataFrame, limit: int | Column) -> DataFrame:
    """One row with the totals at a context limit that need not be a length that occurs: the next shorter length tells."""
    last = sums.filter(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "docs_fitting", "tokens_fitting")).alias("s"))
    whole = sums.agg(F.max("docs_fitting").alias("docs"), F.max("tokens_fitting").alias("tokens"))
    fit, tokens = F.coalesce(F.col("s.docs_fitting"), F.lit(0)), F.coalesce(F.col("s.tokens_fitting"), F.lit(0))
    kept = tokens + F.lit(limit) * (F.coalesce("docs", F.lit(0)) - fit)
    return last.crossJoin(F.broadcast(whole)).select(F.lit(limit).alias("context_limit"), fit.alias("docs_fitting"), kept.alias("tokens_kept"), (F.coalesce("tokens", F.lit(0)) - kept).alias("tokens_cut"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share q of the documents do not exceed (null for an empty table)."""
    return sums.filter(F.col("share_fitting") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = histogram(bpe.lengths(common.table(spark, sf_dir, "documents")))
    return running_sums(common.stored(counted, "histogram"))  # read by two branches, encoded once

"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprints, line_dedup, mixing, ngram_join, substring_dedup, suffix_dedup, token_counts, toxicity
from .common import Query


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_bpe": bpe.op2_bpe,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": line_dedup.OP5_SQL,
        "op6_ngram_join": ngram_join.OP6_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op8_substring_dedup": substring_dedup.OP8_SQL,
        "op10_suffix_dedup": suffix_dedup.OP10_SQL,
    }

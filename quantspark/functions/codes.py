"""Column functions of code texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantspark.config import CODE_REGEX, DIM_PART_REGEX, anchored

_NX = r"^([0-9]+)[xX](?=[A-ZÅÄÖ])"


def is_code(text: Column, pattern: str = CODE_REGEX) -> Column:
    return text.rlike(anchored(pattern))


def nx_count(text: Column) -> Column:
    """N of 'Nx' notation, else 1."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, _NX, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(1))


def nx_base(text: Column) -> Column:
    """The code behind 'Nx'."""
    return F.regexp_replace(text, _NX, "")


def has_inline_dimension(base: Column, pattern: str = DIM_PART_REGEX) -> Column:
    """Whether the last of several '-' parts is a dimension."""
    parts = F.split(base, "-")
    return (F.size(parts) >= 2) & F.element_at(parts, -1).rlike(anchored(pattern))


def full_code(base: Column, dimension: Column) -> Column:
    return F.concat_ws("-", base, F.nullif(dimension, F.lit("")))


def full_prefix(code: Column) -> Column:
    """What stands before the first '-'."""
    return F.split_part(code, F.lit("-"), F.lit(1))


def letter_prefix(code: Column) -> Column:
    """The letters that begin the full prefix, or all of it."""
    head = full_prefix(code)
    return F.coalesce(F.nullif(F.regexp_extract(head, r"^[A-ZÅÄÖ]+", 0), F.lit("")), head)

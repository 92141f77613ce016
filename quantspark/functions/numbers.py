"""Numbers in and out of text, with Python's rounding where results are compared to the last digit.

round() and format_string() of Spark round halves of the decimal text away
from zero. format_number with a pattern rounds the exact value of the binary
double, halves to even, as Python does; it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(v: Column, digits: int) -> Column:
    v = v.cast("double")
    text = F.call_function("format_number", v, F.lit("0" + "." * (digits > 0) + "0" * digits))
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e300), text)


def round_exact(v: Column, digits: int) -> Column:
    """Python's round of a double to some digits; null, nan and infinities as they are."""
    return F.coalesce(_fixed(v, digits).cast("double"), v.cast("double"))


def format_exact(v: Column, digits: int, comma: bool = False) -> Column:
    """Python's fixed-point format of a double; null gives the empty text."""
    text = F.coalesce(_fixed(v, digits), F.lit(""))
    return F.replace(text, F.lit("."), F.lit(",")) if comma else text


def decimal_comma(v: Column) -> Column:
    """One decimal and a comma; null gives the empty text."""
    return format_exact(v, 1, comma=True)


def to_number(text: Column) -> Column:
    """A double from text with decimal comma, spaces and no-break spaces; null if it is none."""
    return F.translate(F.trim(text), ",\u00a0 ", ".").try_cast("double")


def to_whole(text: Column) -> Column:
    """The whole part of `to_number`."""
    v = to_number(text)
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")

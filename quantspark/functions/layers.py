"""Column functions of CAD layer names: discipline - building part - type - system, after an optional 'file|'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantspark.config import AIR, COOLING, HEAT, SEWER, WATER

# Codes of the layer standard.
PART_SYSTEMS = {"52": WATER, "53": SEWER, "56": HEAT, "55": COOLING, "57": AIR}
LETTER_SYSTEMS = {"S": SEWER, "D": SEWER, "V": WATER, "K": WATER}
DISCIPLINE, LINE_TYPES, TEXT_TYPES = "V", ("FE",), ("T", "TX")


def layer_name(raw: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(raw, F.lit("")), r"[|]"), -1))


def fields(raw: Column) -> Column:
    return F.filter(F.split(layer_name(raw), "-"), lambda f: f != "")


def discipline(raw: Column) -> Column:
    return F.upper(F.substring(layer_name(raw), 1, 1))


def is_pipe_layer(raw: Column) -> Column:
    upper = F.transform(fields(raw), F.upper)
    has = lambda names: F.arrays_overlap(upper, F.array(*[F.lit(n) for n in names]))
    return (discipline(raw) == DISCIPLINE) & ~has(TEXT_TYPES) & has(LINE_TYPES)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def system_for_layer(raw: Column) -> Column:
    """The system of a building part (not of the first field), else of the last field that is a letter and a digit."""
    f = fields(raw)
    parts = F.filter(F.transform(F.slice(f, F.lit(2), F.greatest(F.size(f), F.lit(1))), lambda x: F.regexp_extract(x, r"^(\d{2})", 1)), lambda x: x.isin(*PART_SYSTEMS))
    letters = F.filter(F.transform(F.reverse(f), lambda x: F.regexp_extract(F.upper(x), r"^([A-ZÅÄÖ])\d", 1)), lambda x: x.isin(*LETTER_SYSTEMS))
    return F.coalesce(F.try_element_at(_map(PART_SYSTEMS), F.try_element_at(parts, F.lit(1))), F.try_element_at(_map(LETTER_SYSTEMS), F.try_element_at(letters, F.lit(1))))


def system_id_for_layer(raw: Column) -> Column:
    """The last field that is a letter and one or two digits."""
    found = F.filter(F.reverse(F.transform(fields(raw), F.upper)), lambda x: x.rlike(r"^[A-ZÅÄÖ]\d{1,2}$"))
    return F.try_element_at(found, F.lit(1))

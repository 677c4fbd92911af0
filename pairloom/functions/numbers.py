"""Strict parsing. Each parser returns the value or null, and ``*_ok`` tells
whether the text was acceptable, so a bad cell is reported instead of lost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import strip

# Text shapes accepted as numbers and as zoned stamps.
DECIMAL_SHAPE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
INTEGER_SHAPE = r"^[+-]?\d+$"
ZONE_SHAPE = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_number(
    col: Column,
    lo: float | None = None,
    hi: float | None = None,
    allow_blank: bool = False,
    kind: str = "double",
) -> Column:
    """struct<value, ok>: finite number inside [lo, hi]."""
    text = strip(col)
    shape = INTEGER_SHAPE if kind in ("int", "bigint") else DECIMAL_SHAPE
    value = F.when(text.rlike(shape), text.try_cast(kind))
    ok = value.isNotNull()
    if kind in ("double", "float"):
        ok = ok & (F.abs(value) < float("inf"))
    if lo is not None:
        ok = ok & (value >= lo)
    if hi is not None:
        ok = ok & (value <= hi)
    ok = F.coalesce(ok, F.lit(False))
    valid = ok
    if allow_blank:
        valid = ok | F.coalesce(text == "", F.lit(True))
    return F.struct(F.when(ok, value).alias("value"), valid.alias("ok"))


def parse_fraction(col: Column) -> Column:
    """struct<value, ok>: a value above 1 is read as a percentage."""
    number = parse_number(col)["value"]
    scaled = F.when(number > 1, number / 100).otherwise(number)
    ok = F.coalesce((scaled >= 0) & (scaled <= 1), F.lit(False))
    return F.struct(F.when(ok, scaled).alias("value"), ok.alias("ok"))


def parse_bool(col: Column) -> Column:
    """True or false for the exact words in any case, otherwise null."""
    word = F.lower(strip(col))
    return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))


def parse_zoned_ts(col: Column) -> Column:
    """Timestamp, or null when the text is malformed or carries no zone."""
    text = strip(col)
    return F.when(text.rlike(ZONE_SHAPE), text.try_cast("timestamp"))


def parse_date(col: Column) -> Column:
    text = strip(col)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))

"""Column helpers that follow browser-side (ECMAScript) value rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading part of a text that a browser reads as a number.
_FLOAT_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_INT_PREFIX = r"^\s*([+-]?\d+)"

_MAX_INDEX = 4294967295  # unsigned 32-bit column


def float_prefix(text: Column) -> Column:
    """Number at the start of `text`; 0 when there is none or it is not finite."""
    number = F.nullif(F.regexp_extract(text, _FLOAT_PREFIX, 1), F.lit("")).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number).otherwise(F.lit(0.0))


def int_prefix(text: Column) -> Column:
    """Whole number at the start of `text`; 0 when there is none.

    Digits beyond 18 places are far outside every stored range, so the value is read
    as a double first and clamped by the callers.
    """
    number = F.nullif(F.regexp_extract(text, _INT_PREFIX, 1), F.lit("")).try_cast("double")
    return F.coalesce(number, F.lit(0.0))


def percent(text: Column) -> Column:
    """Whole number at the start of `text`, held within 0..100."""
    return F.least(F.greatest(int_prefix(text), F.lit(0.0)), F.lit(100.0)).cast("short")


def count_number(text: Column) -> Column:
    """Non-negative whole number at the start of `text`."""
    return F.least(F.greatest(int_prefix(text), F.lit(0.0)), F.lit(float(_MAX_INDEX))).cast("long")


def clip(text: Column, length: int) -> Column:
    """First `length` characters; '' for NULL."""
    return F.coalesce(F.left(text, F.lit(length)), F.lit(""))


def filled(text: Column) -> Column:
    return text != ""


def first_filled(*texts: Column) -> Column:
    """First value that is not '' or NULL, else ''."""
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(""))


_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def readable_size(size: Column) -> Column:
    """Bytes as text with a binary unit and two decimals, e.g. `1.50 MiB`."""
    out = F.concat(F.format_string("%.2f", size.cast("double")), F.lit(" B"))
    for power, unit in enumerate(_UNITS[1:], start=1):
        scaled = F.format_string("%.2f", size / F.lit(float(1024**power)))
        out = F.when(size >= 1024**power, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out

"""Number-in-text columns and the rounding used for change percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

# Patterns of a table value, of its change in brackets, and of a rate.
VALUE = r"\d{1,3}(?:[,.]\d{1,6})?"
CHANGE = r"(?iu)\(([+-]?[\d,.]+)\s*(?:%|п\.п\.?)\)"
RATE = r"(?<!\d)(\d{1,2}[,.]\d{1,2}|\d{1,2})(?!\d)"


def decimal_text(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def parse_value_change(c: Column) -> Column:
    """Cell text to struct<value,change_pct>: first 1-3 digit number, and a change in brackets."""
    def parse(s: Column) -> Column:
        empty = s.isin("", "—", "-")
        value = decimal_text(F.regexp_extract(s, f"({VALUE})", 1))
        change = decimal_text(F.regexp_extract(s, CHANGE, 1))
        return F.struct(F.when(~empty, value).alias("value"), F.when(~empty, change).alias("change_pct"))

    return let(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\n\r]", " ")), parse)


def rate_value(c: Column) -> Column:
    """First free-standing number of one or two digits (two decimals at most)."""
    return decimal_text(F.regexp_extract(F.coalesce(c, F.lit("")), RATE, 1))


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Round with halves toward plus infinity."""
    p = float(10 ** digits)
    return F.floor(c * p + 0.5) / p


def change_pct(value: Column, previous: Column) -> Column:
    """Change in percent of the previous value; NULL when it is missing, not finite or zero."""
    usable = previous.isNotNull() & ~F.isnan(previous) & (F.abs(previous) != float("inf")) & (previous != 0)
    return F.when(usable, round_half_up((value - previous) / F.abs(previous) * 100))

"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    """Remove every kind of blank from both ends."""
    return F.trim(col, F.lit(WHITESPACE))


def is_series(col: Column, series: str = "EQ") -> Column:
    """Blank-insensitive series test; null counts as "not this series"."""
    return F.coalesce(strip(col) == F.lit(series), F.lit(False))


def alpha_first(col: Column) -> Column:
    """Sort bucket: 1 for names starting with a letter, 2 for all others (null and '' too)."""
    return F.when(col.rlike("^[A-Za-z]"), F.lit(1)).otherwise(F.lit(2))


def deep_link(base_url: str, symbol: Column, day: Column) -> Column:
    """Link to the detail page of one symbol on one day; the symbol is encoded (`M&M`)."""
    return F.format_string(
        "%s/?symbol=%s&date=%s", F.lit(base_url), F.url_encode(symbol), F.date_format(day, "yyyy-MM-dd")
    )

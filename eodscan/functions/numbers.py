"""Numeric expressions. Division never raises: a zero or null divisor gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eodscan.functions.text import strip

# Averages are taken over values rounded to this many decimals (see operators.frames).
SCALE = 6


def at_scale(col: Column, scale: int = SCALE) -> Column:
    """The value as the averages see it, so that "equal to its own average" compares equal."""
    return F.round(col, scale)


def unit_ratio(quantity: Column, trades: Column) -> Column:
    """Units per trade."""
    return F.try_divide(quantity.cast("double"), trades)


def percent_change(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before) * 100


# Larger values are no prices or quantities; averages are exact below this.
LARGEST = 1e15


def number_or_null(text: Column) -> Column:
    """Text to double; text that is no number, NaN, or LARGEST and beyond give null."""
    value = strip(text).try_cast("double")
    return F.when(F.abs(value) < LARGEST, value)


def whole_number_or_null(text: Column) -> Column:
    """Text to bigint; `12.0` counts as 12, `12.5` gives null."""
    exact = strip(text).try_cast("decimal(38,6)")
    return F.when(exact == F.floor(exact), exact.try_cast("bigint"))


def numbers_or_null(texts: Column) -> Column:
    """number_or_null of each element, cast once; the texts are stripped."""
    values = F.transform(texts, lambda t: t.try_cast("double"))
    return F.transform(values, lambda v: F.when(F.abs(v) < LARGEST, v))


def whole_numbers_or_null(texts: Column) -> Column:
    """whole_number_or_null of each element; plain digits need no decimal."""
    return F.transform(texts, lambda t: F.coalesce(t.try_cast("bigint"), whole_number_or_null(t)))


def two_decimals(col: Column) -> Column:
    """Display text with two decimals; null stays null."""
    return F.when(col.isNotNull(), F.format_string("%.2f", col.cast("double")))

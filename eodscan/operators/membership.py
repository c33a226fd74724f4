"""Set membership between frames: flag lists, the load ledger, calendars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eodscan.schemas import UPLOAD_LOOKBACK


def fno_flag(df: DataFrame, fno: DataFrame, name: str = "is_fno") -> DataFrame:
    """True where the symbol is on the list. Spark sizes the list and broadcasts it if it is small."""
    listed = fno.select("symbol").distinct().withColumn("_listed", F.lit(True))
    return (
        df.join(listed, "symbol", "left")
        .withColumn(name, F.coalesce("_listed", F.lit(False)))
        .drop("_listed")
    )


def available(dates: DataFrame, ledger: DataFrame, on: str = "date1") -> DataFrame:
    """Rows whose date has been loaded."""
    loaded = ledger.select(F.col("date1").alias(on)).distinct()
    return dates.join(loaded, on, "left_semi")


def new_dates_only(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose date has not been loaded yet."""
    return rows.join(ledger.select("date1").distinct(), "date1", "left_anti")


def upload_window(end: Column | None = None, days: int = UPLOAD_LOOKBACK) -> tuple[Column, Column]:
    """First and last day of an upload: the last `days` days up to `end` (today by default)."""
    end = F.current_date() if end is None else end
    return F.date_sub(end, days), end


def _as_date(value: Column | dt.date | str) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("date")


def date_spine(
    spark: SparkSession, start: Column | dt.date | str, end: Column | dt.date | str
) -> DataFrame:
    """Every calendar day from start to end, both included; nothing when end is before start."""
    first, last = _as_date(start), _as_date(end)
    days = F.when(first <= last, F.sequence(first, last))
    return spark.range(1).select(F.explode(days).alias("date1"))


def coverage_gaps(spine: DataFrame, ledger: DataFrame) -> DataFrame:
    """Days of the spine nothing was loaded for (weekends and holidays too)."""
    return spine.join(ledger.select("date1").distinct(), "date1", "left_anti")

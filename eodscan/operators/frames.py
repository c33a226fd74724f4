"""Row windows over a panel of daily series.

All functions expect at most one row per (symbol, date1) within a series, which the loader
guarantees. A window is never run over the whole life of a symbol: the history is cut into spans
of `chunk_days`, every span also receives the few rows before its start that its own windows
reach back to, and those visitors are dropped at the end. One task therefore sees at most
`chunk_days` + lookback rows of a symbol however long its history is, and a panel with few symbols
still spreads over the cluster.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from eodscan.functions.numbers import SCALE
from eodscan.functions.text import is_series
from eodscan.schemas import INDICATOR_LOOKBACK, MEASURES, average_column

CHUNK_DAYS = 512
SPAN_BROADCAST_ROWS = 1_000_000

_DAY, _CHUNK = "_day", "_chunk"


def equity(bars: DataFrame, series: str = "EQ") -> DataFrame:
    return bars.filter(is_series(F.col("series"), series))


# --- lookbacks ----------------------------------------------------------------------------------


def lookback(
    df: DataFrame, as_of: dt.date | str | Iterable[dt.date | str], days: int
) -> DataFrame:
    """Rows dated as_of-days .. as_of (both included) with the column `as_of` added.

    For one date this is a plain filter that prunes date partitions. For several dates each row is
    repeated for every date whose span covers it, by an equi-join on date1 with the listed days.
    """
    if isinstance(as_of, (str, dt.date)):
        end = F.lit(as_of).cast("date")
        return df.filter(F.col("date1").between(F.date_sub(end, days), end)).withColumn("as_of", end)
    dates = sorted({d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in as_of})
    listed = df.sparkSession.createDataFrame([(d,) for d in dates], "as_of date")
    spans = listed.select(
        "as_of",
        F.explode(F.sequence(F.date_sub("as_of", days), F.col("as_of"))).alias("date1"),
    )
    if len(dates) * (days + 1) <= SPAN_BROADCAST_ROWS:
        spans = F.broadcast(spans)
    return df.filter(in_spans(F.col("date1"), dates, days)).join(spans, "date1")


def in_spans(day: Column, dates: Iterable[dt.date], days: int) -> Column:
    """Whether a day lies in one of the spans date-days .. date; touching spans are one range."""
    reach, ranges = dt.timedelta(days=days), []
    for date in sorted(dates):
        if ranges and date - reach <= ranges[-1][1] + dt.timedelta(days=1):
            ranges[-1][1] = date
        else:
            ranges.append([date - reach, date])
    inside = F.lit(False)
    for first, last in ranges:
        inside = inside | day.between(F.lit(first), F.lit(last))
    return inside


def recency_rank(df: DataFrame, by: Iterable[str] = ("symbol",), name: str = "rn") -> DataFrame:
    """1 for the latest row of each group, 2 for the one before it, and so on."""
    latest_first = Window.partitionBy(*by).orderBy(F.col("date1").desc())
    return df.withColumn(name, F.row_number().over(latest_first))


# --- exact means --------------------------------------------------------------------------------
# Sums run over integers: the whole part of a value, and its millionths. So they do not depend on
# the order of addition, and the one division at the end is correctly rounded: the mean of equal
# values is exactly that value, and "x > its average" is false for a flat series. Both parts are
# plain longs, which windows add without boxing.

_ONE = 10**SCALE
_COUNTER = 1 << 20  # in running sums a part for the number of rows stands below the millionths


def _whole(col: Column) -> Column:
    return F.floor(col.cast("double"))


def _millionths(col: Column) -> Column:
    value = col.cast("double")
    return F.round((value - F.floor(value)) * _ONE).cast("bigint")


def _mean(whole: Column, millionths: Column, count: Column) -> Column:
    in_long = F.abs(whole) < F.lit((1 << 63) // _ONE // 2)
    wide = (whole.cast("decimal(20,0)") * F.lit(_ONE).cast("decimal(8,0)") + millionths).cast("double")
    total = F.when(in_long, (whole * _ONE + millionths).cast("double")).otherwise(wide)
    return F.try_divide(total, count * F.lit(_ONE))


def exact_mean(col: Column) -> Column:
    """Aggregate: mean of the non-null values, independent of row order."""
    return _mean(F.sum(_whole(col)), F.sum(_millionths(col)), F.count(col))


# --- chunked windows ----------------------------------------------------------------------------


def _home_chunk(chunk_days: int) -> Column:
    return F.floor(F.unix_date("date1") / F.lit(chunk_days))


def to_chunks(df: DataFrame, reach_days: int, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """Assign rows to spans; rows within `reach_days` of the next span are also sent there."""
    if reach_days > chunk_days:
        raise ValueError(f"chunk_days={chunk_days} must be at least reach_days={reach_days}")
    own = _home_chunk(chunk_days)
    visits_next = F.unix_date("date1") + reach_days >= (own + 1) * chunk_days
    return df.select(
        "*",
        F.unix_date("date1").alias(_DAY),
        F.explode(F.when(visits_next, F.array(own, own + 1)).otherwise(F.array(own))).alias(_CHUNK),
    )


def from_chunks(df: DataFrame, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    return df.filter(F.col(_CHUNK) == _home_chunk(chunk_days)).drop(_CHUNK, _DAY)


def _in_order(by: Iterable[str]):
    return Window.partitionBy(*by, _CHUNK).orderBy(_DAY)


def add_averages(
    chunks: DataFrame,
    measures: Mapping[str, tuple[str, Mapping[int, int]]],
    lookback_days: int,
    by: Iterable[str] = ("symbol",),
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Trailing means on an already chunked frame; see `moving_averages`.

    `extra` columns (window expressions over the same order) are computed in the same pass.

    The mean over the last n rows is a difference of two running sums, so the work per row does
    not grow with n. The lower end of the frame is whichever comes later: n rows back, or the last
    row older than the lookback.
    """
    names = list(measures)
    row_counts = sorted({n for _, tiers in measures.values() for n in tiers.values()})
    order = _in_order(by)
    upto_now = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    too_old = order.rangeBetween(Window.unboundedPreceding, -(lookback_days + 1))

    extra = dict(extra or {})
    kept = [*chunks.columns, *extra]
    counted = chunks.select(
        "*",
        *[F.coalesce(_whole(F.col(m)), F.lit(0)).alias(f"_w_{m}") for m in names],
        *[F.coalesce(_millionths(F.col(m)) * _COUNTER + 1, F.lit(0)).alias(f"_p_{m}") for m in names],
    )
    running = counted.select(
        *chunks.columns,
        *[column.alias(name) for name, column in extra.items()],
        F.row_number().over(order).alias("_pos"),
        *[F.sum(f"_{part}_{m}").over(upto_now).alias(f"_s{part}_{m}") for part in "wp" for m in names],
    )

    def state(of: list[str]) -> Column:
        return F.struct("_pos", *[f"_s{part}_{m}" for part in "wp" for m in of])

    def using(n: int) -> list[str]:
        return [m for m in names if n in measures[m][1].values()]

    bounded = running.select(
        "*",
        F.last(state(names)).over(too_old).alias("_old"),
        *[F.lag(state(using(n)), n).over(order).alias(f"_back_{n}") for n in row_counts],
    )

    def average(m: str, n: int) -> Column:
        rows_decide = F.col(f"_back_{n}._pos") >= F.coalesce(F.col("_old._pos"), F.lit(0))

        def since_start(name: str) -> Column:
            before = F.when(rows_decide, F.col(f"_back_{n}.{name}")).otherwise(F.col(f"_old.{name}"))
            return F.col(name) - F.coalesce(before, F.lit(0))

        parts = since_start(f"_sp_{m}")
        return _mean(since_start(f"_sw_{m}"), F.shiftright(parts, 20), parts.bitwiseAND(F.lit(_COUNTER - 1)))

    return bounded.select(
        *kept,
        *[
            average(m, n).alias(average_column(stem, k))
            for m, (stem, tiers) in measures.items()
            for k, n in tiers.items()
        ],
    )


def prev_day(measure: str, by: Iterable[str] = ("symbol",)) -> Column:
    """Value of the calendar day before, for use on an already chunked frame."""
    order = _in_order(by)
    is_yesterday = F.lag(_DAY).over(order) == F.col(_DAY) - 1
    return F.when(is_yesterday, F.lag(measure).over(order))


def moving_averages(
    bars: DataFrame,
    measures: Mapping[str, tuple[str, Mapping[int, int]]] = MEASURES,
    lookback_days: int = INDICATOR_LOOKBACK,
    chunk_days: int = CHUNK_DAYS,
) -> DataFrame:
    """Trailing means for every date at once.

    `measures` maps a column to (stem of the new columns, {tier: rows}). A frame holds the last
    `rows` rows of the symbol, but none dated more than `lookback_days` before the row itself;
    short histories average the rows there are, nulls are ignored.
    """
    chunks = to_chunks(bars, lookback_days, chunk_days)
    return from_chunks(add_averages(chunks, measures, lookback_days), chunk_days)


def prev_day_value(
    bars: DataFrame, measure: str, name: str | None = None, chunk_days: int = CHUNK_DAYS
) -> DataFrame:
    """Value on the calendar day before: null after a weekend, a holiday or a gap."""
    chunks = to_chunks(bars, 1, chunk_days)
    return from_chunks(chunks.withColumn(name or f"prev_{measure}", prev_day(measure)), chunk_days)

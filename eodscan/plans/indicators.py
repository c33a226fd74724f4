"""The derived table: moving averages, trend flags and spike flags per symbol and date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from eodscan.functions.numbers import percent_change
from eodscan.operators.frames import (
    CHUNK_DAYS,
    add_averages,
    equity,
    from_chunks,
    in_spans,
    prev_day,
    to_chunks,
)
from eodscan.operators.signals import spike_signals, tier_signals
from eodscan.schemas import INDICATOR_COLUMNS, INDICATOR_LOOKBACK, KEYS, MEASURES


def with_price_change(bars: DataFrame) -> DataFrame:
    close, before = F.col("close_price"), F.col("prev_close")
    return bars.withColumns(
        {
            "price_change": (close - before).cast("double"),
            "pricechange_per": percent_change(close.cast("double"), before.cast("double")),
        }
    )


def build_indicators(
    bars: DataFrame,
    as_of: dt.date | str | Iterable[dt.date | str] | None = None,
    lookback_days: int = INDICATOR_LOOKBACK,
    chunk_days: int = CHUNK_DAYS,
) -> DataFrame:
    """Indicators for one date, a list of dates, or (None) every date of the bars in one job.

    All three give the same rows for a date, because every frame is cut at the lookback of its own
    row. One shuffle: averages and the previous-day value share the chunked windows.
    """
    rows = equity(bars)
    if as_of is not None:
        if isinstance(as_of, (str, dt.date)):
            as_of = [as_of]
        wanted = sorted({_as_date(d) for d in as_of})
        rows = rows.filter(in_spans(F.col("date1"), wanted, lookback_days))
    rows = with_price_change(rows.select(*KEYS, "prev_close", *_stored_measures()))

    chunks = to_chunks(rows, lookback_days, chunk_days)
    averaged = add_averages(
        chunks, MEASURES, lookback_days, extra={"prev_ratio": prev_day("ratio")}
    )
    built = from_chunks(averaged, chunk_days)
    if as_of is not None:
        built = built.filter(F.col("date1").isin(wanted))
    return spike_signals(tier_signals(built)).select(*INDICATOR_COLUMNS)


def _as_date(value: dt.date | str) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def _stored_measures() -> list[str]:
    return [m for m in MEASURES if m not in ("price_change", "pricechange_per")]

"""Per-symbol reports, computed for all symbols at once and narrowed only by parameters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from eodscan.operators.frames import equity, lookback
from eodscan.operators.shapes import ladder, reindex
from eodscan.operators.signals import bands, top2_flags
from eodscan.schemas import HISTORY_LOOKBACK, INDICATOR_COLUMNS, KEYS, LONG_TIERS

SNAPSHOT_FACTS = ["close_price", "prev_close", "deliv_per", "ratio", "turnover_lacs", "avg_price"]
HISTORY_FACTS = [*SNAPSHOT_FACTS, "deliv_qty"]

# columns of the history whose two largest values are highlighted
HIGHLIGHTED = ["deliv_per", "ratio", "deliv_qty", "volume"]


def _facts_with_indicators(bars: DataFrame, indicators: DataFrame, facts: list[str]) -> DataFrame:
    """Inner join on all three keys; turnover is called volume in these reports.

    Indicators exist for EQ rows only, so the facts are narrowed to those before the join. Both sides hold
    a key once (the loader sees to it), so the join can't repeat rows.
    """
    narrow = equity(bars).select(*KEYS, *facts)
    return indicators.join(narrow, KEYS).withColumnRenamed("turnover_lacs", "volume")


def _narrow(
    df: DataFrame, symbols: Iterable[str] | None, dates: Iterable[dt.date | str] | None
) -> DataFrame:
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    if dates is not None:
        df = df.filter(F.col("date1").isin([dt.date.fromisoformat(str(d)) for d in dates]))
    return df


def snapshot(
    bars: DataFrame,
    indicators: DataFrame,
    symbols: Iterable[str] | None = None,
    dates: Iterable[dt.date | str] | None = None,
) -> DataFrame:
    """Prices and indicators of each (symbol, date): exactly one row per key."""
    kept = [*KEYS, *[c for c in SNAPSHOT_FACTS if c != "turnover_lacs"], "volume"]
    kept += [c for c in INDICATOR_COLUMNS if c not in KEYS and not c.startswith("spike_")]
    joined = _facts_with_indicators(bars, indicators, SNAPSHOT_FACTS)
    return _narrow(joined, symbols, dates).select(*kept)


def symbol_ladder(
    bars: DataFrame,
    indicators: DataFrame,
    symbols: Iterable[str] | None = None,
    dates: Iterable[dt.date | str] | None = None,
) -> DataFrame:
    return ladder(snapshot(bars, indicators, symbols, dates))


HISTORY_COLUMNS = [
    "as_of",
    "symbol",
    "date1",
    "prev_close",
    "close_price",
    "avg_price",
    "price_change",
    "pricechange_per",
    "deliv_per",
    "ratio",
    "deliv_qty",
    "volume",
    *[f"band_t{k}" for k in LONG_TIERS],
    "spike_vs_avg",
    "spike_vs_prev_day",
    *[f"top2_{c}" for c in HIGHLIGHTED],
]


def signal_history(
    bars: DataFrame,
    indicators: DataFrame,
    as_of: dt.date | str | Iterable[dt.date | str],
    days: int = HISTORY_LOOKBACK,
    symbols: Iterable[str] | None = None,
) -> DataFrame:
    """Bands, spikes and highlights over the last `days` days.

    Sorted, latest first, for one date or named symbols; bulk results of many dates are left as they lie.
    """
    joined = _narrow(_facts_with_indicators(bars, indicators, HISTORY_FACTS), symbols, None)
    bulk = symbols is None and not isinstance(as_of, (str, dt.date))
    banded = bands(joined)  # a row's bands are the same for every date that shows it
    if bulk:
        # dealt out before the dates repeat the rows; the groups of a symbol's dates are then served where they lie
        banded = banded.select(*[c for c in HISTORY_COLUMNS if c in banded.columns]).repartition("symbol")
    flagged = top2_flags(lookback(banded, as_of, days), HIGHLIGHTED, ("as_of", "symbol"))
    shown = reindex(flagged, HISTORY_COLUMNS)
    return shown if bulk else shown.orderBy("symbol", "as_of", F.col("date1").desc())


def symbol_list(bars: DataFrame) -> DataFrame:
    return equity(bars).select("symbol").distinct()


# --- fixed values: display names -------------------------------------------------------------------
HISTORY_LABELS = {
    "date1": "Date",
    "prev_close": "Prv Close",
    "close_price": "Close Price",
    "avg_price": "Avg Price",
    "price_change": "Price Change",
    "pricechange_per": "% P.Change",
    "deliv_per": "% Delivery",
    "ratio": "Ratio",
    "deliv_qty": "Del Qty",
    "volume": "Volume",
    **{f"band_t{k}": f"Signal {k}" for k in LONG_TIERS},
    "spike_vs_avg": "MSignal 1",
    "spike_vs_prev_day": "MSignal 2",
}
LADDER_LABELS = {
    "avg_days": "Avg. Days",
    "cmp": "CMP",
    "avg_price": "Avg. Price",
    "price_change": "Price Change",
    "pct_change": "% Change",
    "pct_delivery": "% Delivery",
    "ratio": "Ratio",
    "volume": "Volume",
    "cmp_avg_p_signal": "CMP / AVG.P Signal",
    "avg_p_signal": "AVG.P Signal",
    "percent_delivery_signal": "% Delivery Signal",
    "ratio_signal": "Ratio Signal",
    "period1": "Period1",
    "delivery1_pct": "Delivery1 %",
    "ratio1": "Ratio1",
    "period2": "Period2",
    "delivery2_pct": "Delivery2 %",
    "ratio2": "Ratio2",
}

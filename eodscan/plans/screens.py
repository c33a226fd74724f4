"""All-symbol reports: the dashboard and the spike list."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from eodscan.functions.numbers import percent_change, two_decimals
from eodscan.functions.text import alpha_first
from eodscan.operators.frames import equity, in_spans, lookback
from eodscan.operators.membership import available, fno_flag
from eodscan.operators.shapes import latest_pivot, serial_number
from eodscan.operators.signals import label
from eodscan.schemas import LONG_TIERS, SCREEN_LOOKBACK, average_column

SCREEN_INPUTS = [
    "symbol",
    "series",
    "date1",
    "ratio",
    "close_price",
    "prev_close",
    "turnover_lacs",
    "ttl_trd_qnty",
    "deliv_per",
]

AsOf = dt.date | str | Iterable[dt.date | str]


def _loaded_dates(ledger: DataFrame, as_of: AsOf) -> DataFrame:
    dates = [as_of] if isinstance(as_of, (str, dt.date)) else list(as_of)
    rows = [(str(d),) for d in dates]
    asked = ledger.sparkSession.createDataFrame(rows, "as_of string")
    return available(asked.select(F.col("as_of").cast("date").alias("as_of")), ledger, "as_of")


def _screen_rows(bars: DataFrame, ledger: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    """EQ rows in the lookback of each date; dates that are not in the ledger give no rows."""
    rows = lookback(equity(bars).select(*SCREEN_INPUTS), as_of, days)
    return rows.join(F.broadcast(_loaded_dates(ledger, as_of)), "as_of", "left_semi")


def _screen_columns(spike: str) -> dict[str, Column]:
    today, before = F.col("ratio_today"), F.col("ratio_prev_row")
    change = F.round(percent_change(F.col("close_today"), F.col("prev_close")), 2)
    turnover, usual = F.col("turnover_today").cast("double"), F.col("avg_turnover_20_days")
    return {
        "day2_3": label(before.isNotNull() & (today > before * 3), spike),
        "day2_5": label(before.isNotNull() & (today > before * 5), spike),
        "current_price": F.round("close_today", 2),
        "change_of_percent": change.cast("double"),
        "change_text": F.when(F.col("prev_close").isNull(), F.lit("N/A")).otherwise(
            two_decimals(change)
        ),
        "volume_signal": label(turnover > usual, "UP"),
        "highvol_signal": label(turnover > usual * 2, "High"),
    }


DASHBOARD_COLUMNS = [
    "as_of",
    "sr_no",
    "symbol",
    "last_date",
    "day2_3",
    "day2_5",
    "current_price",
    "change_of_percent",
    "change_text",
    "avg_turnover_20_days",
    "turnover_today",
    "volume_signal",
    "highvol_signal",
    "close_price1",
    "close_price2",
    "delivery1_percent",
    "delivery2_percent",
    "ratio1",
    "ratio2",
    "avg_price1",
    "avg_price2",
    "volume1",
    "volume2",
]


def dashboard(
    bars: DataFrame,
    ledger: DataFrame,
    as_of: AsOf,
    lookback_days: int = SCREEN_LOOKBACK,
    spike: str = "SPT",
) -> DataFrame:
    """One row per EQ symbol that traded in the lookback, for each loaded as-of date.

    "Today" is the symbol's latest row in the lookback (`last_date`), which may be older than as_of.
    """
    rows = _screen_rows(bars, ledger, as_of, lookback_days)
    names = rows.select("as_of", "symbol")
    screen = (
        latest_pivot(rows)
        .withColumns(_screen_columns(spike))
        .withColumns(
            {
                "close_price1": F.col("close_today"),
                "close_price2": F.col("pair_close"),
                "delivery1_percent": F.col("delivery_today"),
                "delivery2_percent": F.col("pair_delivery"),
                "ratio1": F.col("ratio_today"),
                "ratio2": F.col("pair_ratio"),
                "avg_price1": F.col("pair_close"),
                "avg_price2": F.col("pair_close"),
                "volume1": F.col("turnover_today"),
                "volume2": F.col("pair_quantity"),
            }
        )
    )
    return serial_number(screen, names).select(*DASHBOARD_COLUMNS)


HOT_CAKE_FLAGS = [
    "cmp_avg_p_signal1",
    "avg_p_signal1",
    "percent_delivery_signal1",
    "ratio_signal1",
    "spike_vs_avg",
    "spike_vs_prev_day",
]
HOT_CAKE_AVERAGES = [average_column(s, k) for s in ("avg_deliv", "avg_ratio") for k in LONG_TIERS]
HOT_CAKE_COLUMNS = [
    "as_of",
    "symbol",
    "last_date",
    "day2_3",
    "day2_5",
    "current_price",
    "change_of_percent",
    "change_text",
    "avg_turnover_20_days",
    "turnover_today",
    "volume_signal",
    "highvol_signal",
    *HOT_CAKE_FLAGS,
    *HOT_CAKE_AVERAGES,
    "is_fno",
]


def hot_cake(
    bars: DataFrame,
    indicators: DataFrame,
    fno: DataFrame,
    ledger: DataFrame,
    as_of: AsOf,
    lookback_days: int = SCREEN_LOOKBACK,
    spike: str = "SP",
) -> DataFrame:
    """Symbols whose ratio jumped against their previous row, with their indicators of that day."""
    rows = _screen_rows(bars, ledger, as_of, lookback_days)
    spikes = (
        latest_pivot(rows, ("symbol", "series"))
        .withColumns(_screen_columns(spike))
        .filter((F.col("day2_3") == spike) | (F.col("day2_5") == spike))
    )
    dates = [as_of] if isinstance(as_of, (str, dt.date)) else as_of
    dates = [d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in dates]
    of_that_day = indicators.filter(in_spans(F.col("date1"), dates, lookback_days)).select(
        "symbol",
        "series",
        F.col("date1").alias("last_date"),
        *HOT_CAKE_FLAGS,
        *HOT_CAKE_AVERAGES,
    )
    joined = spikes.join(of_that_day, ["symbol", "series", "last_date"], "left")
    return alpha_first_sort(fno_flag(joined, fno).select(*HOT_CAKE_COLUMNS))


def alpha_first_sort(df: DataFrame, *before: str) -> DataFrame:
    """Names that start with a letter first, then all others, each in binary order."""
    return df.orderBy(*before, alpha_first(F.col("symbol")), "symbol")


# --- fixed values: display names -------------------------------------------------------------------
DASHBOARD_LABELS = {
    "sr_no": "Sr.No",
    "symbol": "Symbol",
    "day2_3": "Day23",
    "day2_5": "Day25",
    "current_price": "Cur Price",
    "change_of_percent": "% Change",
    "avg_turnover_20_days": "Avg1 Vol",
    "turnover_today": "Vol",
    "volume_signal": "Vol Sgnl",
    "highvol_signal": "HVol Sgnl",
    "close_price1": "Cl Pri1",
    "close_price2": "Cl Pri2",
    "delivery1_percent": "Delvry1 %",
    "delivery2_percent": "Delvry2 %",
    "ratio1": "Ratio1",
    "ratio2": "Ratio2",
    "avg_price1": "Avg Pri1",
    "avg_price2": "Avg Pri2",
    "volume1": "Volume1",
    "volume2": "Volume2",
}
HOT_CAKE_LABELS = {
    "symbol": "Symbol",
    "day2_3": "Day1",
    "day2_5": "Day2",
    "current_price": "Current Price",
    "change_of_percent": "Change of %",
    "avg_turnover_20_days": "Avg Vol",
    "turnover_today": "Volume",
    "volume_signal": "Vol Sgnl",
    "highvol_signal": "HVol Sgnl",
    "cmp_avg_p_signal1": "CMP-AVG P SNGL",
    "avg_p_signal1": "AVG P SGNL",
    "percent_delivery_signal1": "%DEL SGNL",
    "ratio_signal1": "RATIO SGN",
    "spike_vs_avg": "SGN1",
    "spike_vs_prev_day": "SGN2",
    **{average_column("avg_deliv", k): f"Avg Delv {k}" for k in LONG_TIERS},
    **{average_column("avg_ratio", k): f"Avg Ratio {k}" for k in LONG_TIERS},
    "is_fno": "Is_FNO",
}

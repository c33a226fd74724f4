"""Table schemas and the names every other module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the columns of the daily file, in file order -------------------------------
PRICE_COLUMNS = [
    "prev_close",
    "open_price",
    "high_price",
    "low_price",
    "last_price",
    "close_price",
    "avg_price",
    "ttl_trd_qnty",
    "turnover_lacs",
]
COUNT_COLUMNS = ["no_of_trades", "deliv_qty"]
DAILY_COLUMNS = ["symbol", "series", "date1", *PRICE_COLUMNS, *COUNT_COLUMNS, "deliv_per"]

# --- fixed values: moving-average tiers --------------------------------------------------------
# Tier k averages the last n rows; the short ladder has four tiers, the long one seven.
SHORT_TIERS = {1: 3, 2: 5, 3: 8, 4: 13}
LONG_TIERS = {**SHORT_TIERS, 5: 22, 6: 44, 7: 60}

# measure column -> (stem of the averaged columns, tiers)
MEASURES = {
    "close_price": ("avg_close", SHORT_TIERS),
    "avg_price": ("avg_avgpri", SHORT_TIERS),
    "deliv_per": ("avg_deliv", LONG_TIERS),
    "ratio": ("avg_ratio", LONG_TIERS),
    "turnover_lacs": ("avg_vol", SHORT_TIERS),
    "price_change": ("avg_prichange", SHORT_TIERS),
    "pricechange_per": ("avg_pricechange_per", SHORT_TIERS),
}

# measure column -> stem of its four chained trend flags
TREND_FLAGS = {
    "close_price": "cmp_avg_p_signal",
    "avg_price": "avg_p_signal",
    "deliv_per": "percent_delivery_signal",
    "ratio": "ratio_signal",
}

# --- fixed values: lookbacks in calendar days ---------------------------------------------------
INDICATOR_LOOKBACK = 60
SCREEN_LOOKBACK = 65
HISTORY_LOOKBACK = 90
UPLOAD_LOOKBACK = 7


def average_column(stem: str, tier: int) -> str:
    return f"{stem}_{tier}_days"


def average_columns(measures: dict = MEASURES) -> list[str]:
    return [average_column(stem, k) for stem, tiers in measures.values() for k in tiers]


def trend_columns() -> list[str]:
    return [f"{stem}{k}" for stem in TREND_FLAGS.values() for k in SHORT_TIERS]


KEYS = ["symbol", "series", "date1"]
SPIKE_COLUMNS = ["spike_vs_avg", "spike_vs_prev_day"]
INDICATOR_COLUMNS = [
    *KEYS,
    "price_change",
    "pricechange_per",
    *average_columns(),
    *trend_columns(),
    *SPIKE_COLUMNS,
]

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("series", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS],
        *[T.StructField(c, T.LongType()) for c in COUNT_COLUMNS],
        T.StructField("deliv_per", T.DoubleType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("date1", T.DateType()),
    ]
)

INDICATORS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("series", T.StringType()),
        T.StructField("price_change", T.DoubleType()),
        T.StructField("pricechange_per", T.DoubleType()),
        *[T.StructField(c, T.DoubleType()) for c in average_columns()],
        *[T.StructField(c, T.IntegerType()) for c in trend_columns() + SPIKE_COLUMNS],
        T.StructField("date1", T.DateType()),
    ]
)

LEDGER = T.StructType([T.StructField("date1", T.DateType())])

FLAG_LIST = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("series", T.StringType())]
)

REJECTS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("copies", T.LongType()),
    ]
)
STORED_REJECTS = T.StructType([*REJECTS.fields, T.StructField("batch", T.StringType())])

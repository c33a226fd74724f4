"""0/1 flags, labels and bands derived from a bar and its averages.

Every comparison with a null operand is "not true", so a missing value gives 0 or '-'.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from eodscan.functions.numbers import at_scale
from eodscan.schemas import LONG_TIERS, MEASURES, TREND_FLAGS, average_column


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def label(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text)).otherwise(F.lit("-"))


def tier_signals(df: DataFrame, trends: Mapping[str, str] = TREND_FLAGS) -> DataFrame:
    """Chains value > tier 1 > tier 2 > tier 3 > tier 4, one flag per link."""
    new = {}
    for measure, stem in trends.items():
        averages = MEASURES[measure][0]
        links = [at_scale(F.col(measure))]
        links += [F.col(average_column(averages, k)) for k in (1, 2, 3, 4)]
        for k in (1, 2, 3, 4):
            new[f"{stem}{k}"] = flag(links[k - 1] > links[k])
    return df.withColumns(new)


def spike_signals(df: DataFrame, prev: str = "prev_ratio") -> DataFrame:
    """Ratio above twice its longest average, and above twice yesterday's (0 if there was none)."""
    ratio = F.col("ratio")
    return df.withColumns(
        {
            "spike_vs_avg": flag(at_scale(ratio) > F.col(average_column("avg_ratio", 7)) * 2),
            "spike_vs_prev_day": flag(ratio > F.coalesce(F.col(prev), F.lit(0)) * 2),
        }
    )


def bands(df: DataFrame) -> DataFrame:
    """band_t1..band_t7: where ratio and delivery stand against their tier averages."""
    ratio, delivery = at_scale(F.col("ratio")), at_scale(F.col("deliv_per"))
    new = {}
    for k in LONG_TIERS:
        mean_ratio = F.col(average_column("avg_ratio", k))
        mean_delivery = F.col(average_column("avg_deliv", k))
        new[f"band_t{k}"] = (
            F.when((ratio > mean_ratio) & (delivery > mean_delivery), F.lit("High"))
            .when((ratio > mean_ratio) & (delivery < mean_delivery), F.lit("Mid"))
            .when((ratio < mean_ratio) & (delivery > mean_delivery), F.lit("Low"))
            .otherwise(F.lit("-"))
        )
    return df.withColumns(new)


def top2_flags(df: DataFrame, cols: Iterable[str], by: Iterable[str]) -> DataFrame:
    """top2_<col>: is the value one of the two largest of its group (ties with them included)?"""
    # the largest, whether it stands twice, and the largest below it: all kept in bounded state, two passes of one window
    group = Window.partitionBy(*by)
    cols = list(cols)
    df = df.withColumns({f"_max_{c}": F.max(c).over(group) for c in cols})
    below = {f"_below_{c}": F.max(F.when(F.col(c) < F.col(f"_max_{c}"), F.col(c))).over(group) for c in cols}
    ties = {f"_ties_{c}": F.count_if(F.col(c) == F.col(f"_max_{c}")).over(group) for c in cols}
    df = df.withColumns(below | ties)

    def second(c: str) -> Column:
        return F.when(F.col(f"_ties_{c}") > 1, F.col(f"_max_{c}")).otherwise(F.coalesce(f"_below_{c}", f"_max_{c}"))

    flagged = df.withColumns({f"top2_{c}": F.coalesce(F.col(c) >= second(c), F.lit(False)) for c in cols})
    return flagged.drop(*[f"_{part}_{c}" for part in ("max", "below", "ties") for c in cols])


# --- fixed values: which content marks a cell of a report ---------------------------------------
MARKED_LABELS = {
    "day2_3": ["SPT", "SP"],
    "day2_5": ["SPT", "SP"],
    "volume_signal": ["UP"],
    "highvol_signal": ["High"],
}
MARKED_FLAGS = [
    "cmp_avg_p_signal1",
    "avg_p_signal1",
    "percent_delivery_signal1",
    "ratio_signal1",
    "spike_vs_avg",
    "spike_vs_prev_day",
    "cmp_avg_p_signal",
    "avg_p_signal",
    "percent_delivery_signal",
    "ratio_signal",
]


def display_flags(df: DataFrame) -> DataFrame:
    """mark_<col> for every column of a report that has a marking rule.

    Labels and 0/1 signals are marked by content, the symbol by is_fno; bands keep their level
    (mark_band_tK is true for High, Mid and Low) since the band text itself names the shade.
    """
    present = set(df.columns)
    new: dict[str, Column] = {}
    for c, texts in MARKED_LABELS.items():
        if c in present:
            new[f"mark_{c}"] = F.coalesce(F.col(c).isin(texts), F.lit(False))
    for c in MARKED_FLAGS:
        if c in present:
            new[f"mark_{c}"] = F.coalesce(F.col(c) == 1, F.lit(False))
    for k in LONG_TIERS:
        if f"band_t{k}" in present:
            new[f"mark_band_t{k}"] = F.col(f"band_t{k}").isin("High", "Mid", "Low")
    if "is_fno" in present:
        new["mark_symbol"] = F.col("is_fno")
    return df.withColumns(new)

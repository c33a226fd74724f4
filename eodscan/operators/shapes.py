"""Pivots, unpivots and column layout."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from eodscan.operators.frames import exact_mean, recency_rank
from eodscan.schemas import average_column

TURNOVER_ROWS = 20
PAIR_ROWS = 2


def latest_pivot(rows: DataFrame, by: Iterable[str] = ("symbol",)) -> DataFrame:
    """One row per group and as_of: today's and the previous row's values and short averages.

    `rows` comes from `lookback`. Only the 20 latest rows of a symbol matter, so the rank filter is
    applied below the shuffle as well, and the aggregation reuses the partitioning of the ranking.
    """
    recent = recency_rank(rows, ("as_of", "symbol")).filter(F.col("rn") <= TURNOVER_ROWS)

    def at(k: int, c: str) -> Column:
        return F.max(F.when(F.col("rn") == k, F.col(c)))

    def pair_mean(c: str) -> Column:
        return exact_mean(F.when(F.col("rn") <= PAIR_ROWS, F.col(c)))

    return recent.groupBy("as_of", *by).agg(
        at(1, "date1").alias("last_date"),
        at(1, "close_price").alias("close_today"),
        at(1, "ratio").alias("ratio_today"),
        at(2, "ratio").alias("ratio_prev_row"),
        at(1, "prev_close").alias("prev_close"),
        at(1, "turnover_lacs").alias("turnover_today"),
        at(1, "deliv_per").alias("delivery_today"),
        exact_mean(F.col("turnover_lacs")).alias("avg_turnover_20_days"),
        pair_mean("close_price").alias("pair_close"),
        pair_mean("deliv_per").alias("pair_delivery"),
        pair_mean("ratio").alias("pair_ratio"),
        pair_mean("ttl_trd_qnty").alias("pair_quantity"),
    )


# --- fixed values: ladder column -> (today's value, stem of its averages) -------------------------
LADDER_VALUES = {
    "cmp": ("close_price", "avg_close"),
    "avg_price": ("avg_price", "avg_avgpri"),
    "price_change": ("price_change", "avg_prichange"),
    "pct_change": ("pricechange_per", "avg_pricechange_per"),
    "pct_delivery": ("deliv_per", "avg_deliv"),
    "ratio": ("ratio", "avg_ratio"),
    "volume": ("volume", "avg_vol"),
}
LADDER_SIGNALS = [
    "cmp_avg_p_signal",
    "avg_p_signal",
    "percent_delivery_signal",
    "ratio_signal",
]
LADDER_STEPS = 5


def ladder(snapshot: DataFrame) -> DataFrame:
    """Five rows per snapshot row: today, then tiers 1-4, with the long tiers alongside."""

    def maybe(present: bool, col: str, kind: str) -> Column:
        return (F.col(col) if present else F.lit(None)).cast(kind)

    def step(n: int) -> Column:
        short, long = n <= 4, n <= 3
        fields = [F.lit(n).alias("avg_days")]
        for name, (today, stem) in LADDER_VALUES.items():
            source = today if n == 1 else average_column(stem, n - 1)
            fields.append(F.col(source).cast("double").alias(name))
        for stem in LADDER_SIGNALS:
            fields.append(maybe(short, f"{stem}{n}", "int").alias(stem))
        fields += [
            F.lit(n if short else None).cast("int").alias("period1"),
            maybe(short, average_column("avg_deliv", n), "double").alias("delivery1_pct"),
            maybe(short, average_column("avg_ratio", n), "double").alias("ratio1"),
            F.lit(n if long else None).cast("int").alias("period2"),
            maybe(long, average_column("avg_deliv", n + 4), "double").alias("delivery2_pct"),
            maybe(long, average_column("avg_ratio", n + 4), "double").alias("ratio2"),
        ]
        return F.struct(*fields)

    steps = F.array(*[step(n) for n in range(1, LADDER_STEPS + 1)])
    return snapshot.select("symbol", "date1", F.inline(steps))


def reindex(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones are null."""
    present = set(df.columns)
    return df.select(*[c if c in present else F.lit(None).alias(c) for c in columns])


def relabel(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Internal names to display names."""
    return df.withColumnsRenamed(dict(labels))


SERIAL_CUTS = 200
_CUT_SAMPLE = 4000


def serial_number(
    df: DataFrame, names: DataFrame, within: str = "as_of", by: str = "symbol", name: str = "sr_no"
) -> DataFrame:
    """1..n in `by` order within each `within` group, without sorting a group in one task.

    `names` holds the (within, by) pairs of `df` and should be cheap to scan; `by` is unique in a
    group. A fixed-size sample of it cuts the order into slices, each slice is numbered on its own
    and shifted by the sizes of the slices before it.
    """
    sample = (
        names.select(by).distinct().orderBy(F.xxhash64(by), by).limit(_CUT_SAMPLE).collect()
    )
    values = sorted(r[0] for r in sample if r[0] is not None)
    step = max(1, len(values) // SERIAL_CUTS)
    cuts = F.array(*[F.lit(v) for v in values[step::step]]).cast("array<string>")
    # null sorts first, as it does in orderBy
    slice_no = F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col(by))), F.lit(-1))

    sizes = names.select(within, by).distinct().groupBy(within, slice_no.alias("_slice")).count()
    earlier = (
        Window.partitionBy(within)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = sizes.select(
        within, "_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift")
    )
    in_slice = Window.partitionBy(within, "_slice").orderBy(by)
    return (
        df.withColumn("_slice", slice_no)
        .join(shifts, [within, "_slice"])
        .withColumn(name, F.col("_shift") + F.row_number().over(in_slice))
        .drop("_slice", "_shift")
    )

"""Maps the star-schema test tables to a panel of daily bars.

A bar is one (symbol, series, date1) group of line items. Prices are decimals so that sums are the
same in any order and on any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

PRICE = "decimal(18,4)"
QUOTIENT = "decimal(18,6)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str, grain: str = "s_name") -> DataFrame:
    """(l_suppkey, symbol): the supplier itself, its nation or its region."""
    supplier = read(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    if grain != "s_name":
        nation = read(spark, sf_dir, "nation")
        supplier = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    if grain == "r_name":
        region = read(spark, sf_dir, "region")
        supplier = supplier.join(region, F.col("n_regionkey") == region.r_regionkey)
    return supplier.select("l_suppkey", F.col(grain).alias("symbol"))


def bars(
    spark: SparkSession, sf_dir: str, grain: str = "s_name", period: str = "day"
) -> DataFrame:
    """Bars of all line items, one per day or (period="month") one per month, dated its first day.

    Every aggregate here combines on the map side, so a group may hold any number of lines.
    """
    day = F.col("l_shipdate").cast("date")
    lines = read(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.when(F.col("l_returnflag") == "A", " BE").otherwise(" EQ").alias("series"),
        (day if period == "day" else F.trunc(day, period)).alias("date1"),
        F.col("l_quantity").cast(PRICE).alias("quantity"),
        F.col("l_extendedprice").cast(PRICE).alias("price"),
        (F.col("l_linestatus") == "F").alias("delivered"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    line_order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "price", "quantity")
    grouped = (
        lines.join(symbols(spark, sf_dir, grain), "l_suppkey")
        .groupBy("symbol", "series", "date1")
        .agg(
            F.count(F.lit(1)).alias("no_of_trades"),
            F.sum("quantity").alias("quantity"),
            F.sum("price").alias("turnover"),
            F.sum(F.when(F.col("delivered"), F.col("quantity"))).alias("delivered"),
            F.min(line_order)["price"].alias("open_price"),
            F.max(line_order)["price"].alias("close_price"),
            F.min("price").alias("low_price"),
            F.max("price").alias("high_price"),
        )
    )

    def quotient(top: str, bottom: str, times: int = 1):
        value = F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")) * times
        # rounded by plain double arithmetic, which every engine does alike
        return (F.floor(value * 1_000_000 + 0.5) / 1_000_000).cast(QUOTIENT)

    # After the grouping a series has one row per day at most, so a symbol's rows are bounded by the calendar. Dealt out
    # by symbol once, they serve every later window and join of a symbol as they lie.
    by_day = Window.partitionBy("symbol", "series").orderBy("date1")
    return grouped.repartition("symbol").select(
        "symbol",
        "series",
        F.lag("close_price").over(by_day).alias("prev_close"),
        "open_price",
        "high_price",
        "low_price",
        F.col("close_price").alias("last_price"),
        "close_price",
        quotient("turnover", "quantity").alias("avg_price"),
        F.col("quantity").cast(PRICE).alias("ttl_trd_qnty"),
        F.col("turnover").cast(PRICE).alias("turnover_lacs"),
        "no_of_trades",
        F.col("delivered").cast("bigint").alias("deliv_qty"),
        quotient("delivered", "quantity", 100).alias("deliv_per"),
        quotient("quantity", "no_of_trades").alias("ratio"),
        "date1",
    )


def fno_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "supplier")
        .filter("s_acctbal > 0")
        .select(F.col("s_name").alias("symbol"), F.lit("EQ").alias("series"))
    )


LEDGER_CUTOFF = "2001-07-01"


def ledger(spark: SparkSession, sf_dir: str, cutoff: str | None = None) -> DataFrame:
    """Loaded days: every ship date, or those before the cutoff."""
    dates = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date1"))
    loaded = dates if cutoff is None else dates.filter(F.col("date1") < F.lit(cutoff))
    return loaded.distinct()


def month_ends(ledger_df: DataFrame) -> list:
    """Last loaded day of each month: a short list (twelve entries a year)."""
    last = ledger_df.groupBy(F.trunc("date1", "month")).agg(F.max("date1").alias("as_of"))
    return sorted(r.as_of for r in last.collect())

"""The stored tables: creation, idempotent loading and the refresh after a late load."""

from __future__ import annotations

import bisect
import datetime as dt
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from eodscan import schemas
from eodscan.functions.text import is_series
from eodscan.operators.membership import coverage_gaps, date_spine, new_dates_only
from eodscan.plans.indicators import build_indicators
from eodscan.sources.daily import one_row_per_key, read_daily
from eodscan.sources.scratch import drop_dir, scratch_dir


@dataclass(frozen=True)
class Tables:
    """Names of the tables of one database."""

    db: str

    def _in_db(self, name: str) -> str:
        return f"{self.db}.{name}"

    @property
    def bars(self) -> str:
        return self._in_db("bars")

    @property
    def bars_other(self) -> str:
        return self._in_db("bars_other")

    @property
    def indicators(self) -> str:
        return self._in_db("indicators")

    @property
    def ledger(self) -> str:
        return self._in_db("load_ledger")

    @property
    def fno(self) -> str:
        return self._in_db("fno_symbols")

    @property
    def rejects(self) -> str:
        return self._in_db("load_rejects")


def _create(spark: SparkSession, name: str, schema: StructType, partition: str | None) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = f" PARTITIONED BY ({partition})" if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{by}")


def bootstrap(spark: SparkSession, db: str, location: str | None = None) -> Tables:
    """Create the database and its tables where they do not exist yet."""
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}{at}")
    tables = Tables(db)
    _create(spark, tables.bars, schemas.BARS, "date1")
    _create(spark, tables.bars_other, schemas.BARS, "date1")
    _create(spark, tables.indicators, schemas.INDICATORS, "date1")
    _create(spark, tables.ledger, schemas.LEDGER, None)
    _create(spark, tables.fno, schemas.FLAG_LIST, None)
    _create(spark, tables.rejects, schemas.STORED_REJECTS, "batch")
    return tables


def append_inferred(spark: SparkSession, path: str, table: str) -> None:
    """Append CSV files to a named table, with the types found in the files."""
    df = spark.read.options(header=True, inferSchema=True, escape='"').csv(path)
    df.write.mode("append").format("parquet").saveAsTable(table)


def overwrite_partitions(df: DataFrame, table: str, partition: str) -> None:
    """Replace exactly the partitions that occur in `df`, so a retry leaves no second copy.

    Rows are rebalanced by partition value: small days share a task, a huge day is split.
    """
    spark = df.sparkSession
    layout = spark.table(table)
    shaped = df.select(*[F.col(f.name).cast(f.dataType) for f in layout.schema.fields])
    with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        shaped.hint("rebalance", partition).write.insertInto(table, overwrite=True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def load_days(
    spark: SparkSession,
    good: DataFrame,
    tables: Tables,
    rejects: DataFrame | None = None,
    batch: str | None = None,
    merge: bool = False,
) -> list[dt.date]:
    """Load the days that are not in the ledger yet; returns them.

    Rows of days that are in it are rejects ("day already loaded"), or with merge=True join the stored rows of
    their day; of rows with one key the smallest is kept, whatever came first.

    What arrived is written once to shared storage. Facts and indicators replace their day partitions and
    the ledger is written last, so a load that dies half-way is repeated without harm. Rejects are kept under the
    name of the batch, by default one of its own. The list of days is bounded by the calendar.
    """
    batch = batch or f"load-{uuid.uuid4().hex}"
    scratch = scratch_dir(spark, "load")
    try:
        good.write.parquet(f"{scratch}/arrived")
        arrived = spark.read.schema(good.schema).parquet(f"{scratch}/arrived")
        ledger = spark.table(tables.ledger)
        fresh = new_dates_only(arrived, ledger)
        known = arrived.join(ledger.select("date1").distinct(), "date1", "left_semi")
        days, changed = _days(fresh), []
        refused = [] if rejects is None else [rejects]
        if merge:
            changed = _days(known)
            if changed:
                fresh, surplus = _merged(spark, tables, fresh, known, changed, f"{scratch}/merged")
                refused.append(surplus)
        else:
            refused.append(_reported(known, "day already loaded"))
        if days or changed:
            regular = is_series(F.col("series"))
            overwrite_partitions(fresh.filter(~regular), tables.bars_other, "date1")
            overwrite_partitions(fresh.filter(regular), tables.bars, "date1")
            refresh_after_late_load(spark, tables, [*days, *changed])
        stamped = reduce(DataFrame.unionByName, refused).withColumn("batch", F.lit(batch))
        overwrite_partitions(stamped, tables.rejects, "batch")
        if days:
            listed = spark.createDataFrame([(d,) for d in days], schemas.LEDGER)
            listed.coalesce(1).write.mode("append").insertInto(tables.ledger)
    finally:
        drop_dir(spark, scratch)
    return days


def _days(rows: DataFrame) -> list[dt.date]:
    return sorted(r.date1 for r in rows.select("date1").distinct().collect())


def _reported(rows: DataFrame, reason: str) -> DataFrame:
    shown = F.to_json(F.struct(*schemas.DAILY_COLUMNS))
    return rows.select(
        F.lit(None).cast("string").alias("source"),
        F.lit(reason).alias("reason"),
        shown.alias("raw"),
        F.lit(1).cast("bigint").alias("copies"),
    )


def _merged(
    spark: SparkSession, tables: Tables, fresh: DataFrame, known: DataFrame, days: list[dt.date], path: str
) -> tuple[DataFrame, DataFrame]:
    """Fresh rows and, for known days, stored and new rows with one per key; and the rows beyond these."""
    of_days = F.col("date1").isin(days)
    stored = spark.table(tables.bars).unionByName(spark.table(tables.bars_other)).filter(of_days)
    both = stored.unionByName(known.select(*stored.columns))
    # a row that comes again unchanged is no news
    kept = one_row_per_key(both.distinct()).select(*known.columns)
    kept.unionByName(fresh).write.parquet(path)
    merged = spark.read.schema(fresh.schema).parquet(path)
    surplus = both.distinct().exceptAll(merged.select(*both.columns))
    return merged, _reported(surplus, "duplicate key")


def refresh_after_late_load(
    spark: SparkSession,
    tables: Tables,
    dates: Iterable[dt.date],
    lookback_days: int = schemas.INDICATOR_LOOKBACK,
) -> None:
    """Rebuild the indicators of the given days and of every stored day that looks back on them."""
    changed = sorted(set(dates))
    stored = {r.date1 for r in spark.table(tables.ledger).select("date1").distinct().collect()}
    reach = dt.timedelta(days=lookback_days)

    def looks_back(day: dt.date) -> bool:
        at = bisect.bisect_right(changed, day)
        return at > 0 and day - changed[at - 1] <= reach

    affected = [d for d in sorted(stored | set(changed)) if looks_back(d)]
    built = build_indicators(spark.table(tables.bars), affected, lookback_days)
    overwrite_partitions(built, tables.indicators, "date1")


def load_folder(
    spark: SparkSession,
    folder: str,
    start: dt.date | str,
    end: dt.date | str,
    tables: Tables,
    batch: str | None = None,
) -> DataFrame:
    """Load the files named for start..end; returns the days of the range still without data."""
    good, rejects = read_daily(spark, folder, start, end)
    load_days(spark, good, tables, rejects, batch)
    return coverage_gaps(date_spine(spark, start, end), spark.table(tables.ledger))

"""What the plans of readers and duplicate removal do once per line, whatever the size of the input."""

import contextlib
import io
import re
import time

import pytest
from pyspark.sql import functions as F

from eodscan.checks import queries as registered
from eodscan.plans import build_indicators, signal_history
from eodscan.schemas import BARS
from eodscan.sources import one_row_per_key, read_daily
from eodscan.sources.daily import surplus_rows
from eodscan.sources.scratch import freed_shuffles
from tests.helpers import bar, bars, day
from tests.test_ingest import line, text


def plan_of(df):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("simple")
    return shown.getvalue()


def copies(spark, times):
    keyed = {"symbol": F.lit("A"), "series": F.lit("EQ"), "date1": F.lit("2024-01-02").cast("date")}
    parts = spark.range(times).select((F.col("id") % 2).alias("id"))
    return parts.select(*[keyed.get(f.name, F.col("id")).cast(f.dataType).alias(f.name) for f in BARS.fields])


def test_copies_are_counted_by_hash_before_they_are_sorted(spark):
    rows = copies(spark, 1001)
    kept = one_row_per_key(rows, many_copies=True)
    # plans are printed from the result down to the scan: the count comes last, nothing is sorted after it
    plan = plan_of(kept)
    assert plan.rindex("HashAggregate") > plan.rindex("Sort [")
    assert [r.close_price for r in kept.collect()] == [0.0]
    assert sorted(r.copies for r in surplus_rows(rows).collect()) == [500, 500]


def test_rejects_come_from_one_reading_of_the_lines(spark, tmp_path):
    body = [line("GOOD"), line("BAD", close="ten"), line("BAD", close="ten"), line("TWICE"), line("TWICE"), line("TWICE", close="99")]
    (tmp_path / "a.csv").write_text(text(*body))
    rejects = read_daily(spark, str(tmp_path))[1]
    # the lines, their headers, and the headers' own report
    assert plan_of(rejects).count("FileScan text") <= 3
    got = sorted((r.reason, r.copies) for r in rejects.collect())
    assert got == [("bad number in close_price", 1)] * 2 + [("duplicate key", 1)] * 2


def test_lines_of_rejects_are_shuffled_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text(text(line("GOOD"), line("TWICE"), line("TWICE")))
    plan = plan_of(read_daily(spark, str(tmp_path))[1])
    # by key; besides it only the headers and their report are dealt out, by file
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)", plan)
    assert [c for c in dealt if c != "source"] == ["symbol"], plan


def test_lines_are_not_dealt_out_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(text(line("A")))
    plan = plan_of(read_daily(spark, str(tmp_path))[0])
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.fixture
def no_broadcast(spark):
    """Small test tables are joined like large ones."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def small_market(spark, path):
    lines = spark.range(200).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id % 3 AS l_partkey", "id % 2 AS l_suppkey",
        "double(id) AS l_quantity", "double(id * 10) AS l_extendedprice",
        "'N' AS l_returnflag", "'F' AS l_linestatus", "date_add(date'2001-01-01', int(id / 2)) AS l_shipdate",
    )
    lines.write.parquet(f"{path}/lineitem.parquet")
    spark.range(2).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name").write.parquet(f"{path}/supplier.parquet")
    return str(path)


def dealt_by(plan, *keys):
    return len(re.findall(r"Exchange hashpartitioning\(" + ", ".join(rf"{k}#\d+L?" for k in keys) + ",", plan))


@pytest.mark.parametrize("name", ["symbol_snapshot", "signal_history"])
def test_wide_rows_are_joined_where_they_lie(spark, tmp_path, no_broadcast, name):
    shown = registered.queries()[name](spark, small_market(spark, tmp_path))
    plan = plan_of(shown)
    # once for the grouping into bars in each reading of them; neither spans nor the join deal anything out again
    assert dealt_by(plan, "symbol", "series", "date1") == 2
    assert dealt_by(plan, "symbol", "_chunk") == dealt_by(plan, "as_of", "symbol") == 0
    assert shown.count() == {"symbol_snapshot": 200, "signal_history": 2 * (31 + 59 + 90 + 91)}[name]


def test_files_of_bars_are_small_and_made_in_slices(spark, tmp_path, monkeypatch):
    sf, folders, written = small_market(spark, tmp_path / "tables"), [], []
    whole = {name: sorted(registered.queries()[name](spark, sf).collect(), key=str) for name in ("csv_round_trip", "csv_rejects")}
    write, name_dir = registered._write_csv, registered.scratch_dir
    monkeypatch.setattr(registered, "SLICE_LINES", 50)
    monkeypatch.setattr(registered, "scratch_dir", lambda spark, label: folders.append(name_dir(spark, label)) or folders[-1])
    monkeypatch.setattr(registered, "_write_csv", lambda text, folder: written.append(text.count()) or write(text, folder))
    for name, rows in whole.items():
        assert sorted(registered.queries()[name](spark, sf).collect(), key=str) == rows and rows
    assert len(written) == 2 * 5 and sum(written) == 2 * 200 and max(written) < 200
    names = spark.read.format("binaryFile").load(folders).select("path").collect()
    assert names and all(r.path.endswith(".csv.gz") for r in names)


def test_write_leaves_no_shuffle(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for name in disk.getAllBlocks().mkString(" ").split() if name.startswith("shuffle")}

    before = shuffles()
    with freed_shuffles(spark):
        spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "out"))
    until = time.time() + 5
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before


def test_history_of_many_dates_is_dealt_out_before_dates_repeat_rows(spark, no_broadcast):
    panel = bars(spark, [bar(s, n, ratio=n + 1.0) for s in "AB" for n in range(0, 120, 5)])
    got = signal_history(panel, build_indicators(panel), [day(100), day(115)])
    assert dealt_by(plan_of(got), "as_of", "symbol") == 0
    marked = {(r.symbol, r.as_of, r.date1) for r in got.collect() if r.top2_ratio}
    assert marked == {(s, day(a), day(d)) for s in "AB" for a in (100, 115) for d in (a, a - 5)}

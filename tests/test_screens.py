from pyspark.sql import functions as F

from eodscan.operators import coverage_gaps, date_spine, upload_window
from eodscan.operators.shapes import serial_number
from eodscan.plans import alpha_first_sort, build_indicators, dashboard, hot_cake
from tests.helpers import bar, bars, day, ledger


def test_dashboard_uses_the_latest_row_in_the_lookback(spark):
    rows = [bar("OLD", 10, 1.0), bar("OLD", 12, 3.5), bar("NEW", 70, 1.0), bar("GONE", 4, 1.0)]
    got = dashboard(bars(spark, rows), ledger(spark, 70), day(70)).collect()
    seen = {r.symbol: (r.sr_no, r.last_date, r.day2_3, r.day2_5) for r in got}
    assert seen == {
        "NEW": (1, day(70), "-", "-"),
        "OLD": (2, day(12), "SPT", "-"),
    }


def test_date_that_was_not_loaded_gives_nothing(spark):
    panel = bars(spark, [bar("A", 70)])
    assert dashboard(panel, ledger(spark, 69), day(70)).count() == 0
    assert dashboard(panel, ledger(spark, 69, 70), [day(69), day(70)]).count() == 1


def test_change_text(spark):
    rows = [
        bar("NULL", 1, prev=None),
        bar("ZERO", 1, prev=0.0),
        bar("UP", 1, close=10.5, prev=10.0),
    ]
    got = dashboard(bars(spark, rows), ledger(spark, 1), day(1)).collect()
    assert {r.symbol: (r.change_of_percent, r.change_text) for r in got} == {
        "NULL": (None, "N/A"),
        "ZERO": (None, None),
        "UP": (5.0, "5.00"),
    }


def test_turnover_signals_and_short_averages(spark):
    rows = [bar("A", n, ratio=n + 1.0, turnover=100.0) for n in range(24)]
    rows.append(bar("A", 24, ratio=30.0, turnover=1000.0))
    got = dashboard(bars(spark, rows), ledger(spark, 24), day(24)).collect()[0]
    assert got.avg_turnover_20_days == (19 * 100 + 1000) / 20
    assert (got.volume_signal, got.highvol_signal) == ("UP", "High")
    assert (got.ratio1, got.ratio2) == (30.0, (30.0 + 24.0) / 2)


def test_hot_cake_order_flags_and_left_join(spark):
    rows = []
    for symbol in ("3M", "ZED", "abc"):
        rows += [bar(symbol, 0, 1.0, series=" EQ"), bar(symbol, 1, 6.0, series=" EQ")]
    rows += [bar("CALM", 0, 1.0), bar("CALM", 1, 2.0)]
    panel = bars(spark, rows)
    indicators = build_indicators(panel).filter("symbol <> 'abc'")
    fno = spark.createDataFrame([("ZED", "EQ"), ("ZED", "EQ")], "symbol string, series string")
    got = hot_cake(panel, indicators, fno, ledger(spark, 1), day(1)).collect()
    assert [r.symbol for r in got] == ["ZED", "abc", "3M"]
    assert [r.is_fno for r in got] == [True, False, False]
    assert {(r.day2_3, r.day2_5) for r in got} == {("SP", "SP")}
    assert got[1].avg_ratio_1_days is None and got[0].avg_ratio_1_days == 3.5


def test_alpha_first(spark):
    df = spark.createDataFrame([("3M",), ("",), (None,), ("b",), ("A",)], "symbol string")
    assert [r.symbol for r in alpha_first_sort(df).collect()] == ["A", "b", None, "", "3M"]


def test_serial_number_over_many_slices(spark):
    df = spark.range(9000).select(
        F.lit(1).alias("as_of"), F.concat(F.lit("S"), F.col("id")).alias("symbol")
    )
    df = df.unionByName(spark.createDataFrame([(2, "x"), (2, None)], "as_of int, symbol string"))
    got = serial_number(df, df).collect()
    for group in (1, 2):
        ordered = sorted((r.sr_no, r.symbol or "") for r in got if r.as_of == group)
        assert [n for n, _ in ordered] == list(range(1, len(ordered) + 1))
        assert [s for _, s in ordered] == sorted(s for _, s in ordered)


def test_calendar(spark):
    spine = date_spine(spark, "2024-01-01", "2024-01-05")
    gaps = coverage_gaps(spine, ledger(spark, 0, 1, 3)).collect()
    assert {r.date1 for r in gaps} == {day(2), day(4)}
    assert date_spine(spark, "2024-01-05", "2024-01-01").count() == 0
    start, end = upload_window()
    assert date_spine(spark, start, end).count() == 8

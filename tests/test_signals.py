from pyspark.sql import functions as F

from eodscan.operators import bands, display_flags, ladder, reindex, top2_flags
from eodscan.plans import build_indicators, signal_history, snapshot
from tests.helpers import bar, bars, day


def by_day(df):
    return {r.date1: r for r in df.collect()}


def test_flat_series_has_no_trend_and_no_band(spark):
    panel = bars(spark, [bar("A", n, ratio=0.1, close=0.1, deliv=33.33) for n in range(15)])
    built = build_indicators(panel)
    for r in built.collect():
        assert all(r[c] == 0 for c in built.columns if "_signal" in c)
    banded = bands(snapshot(panel, built))
    assert {r[f"band_t{k}"] for r in banded.collect() for k in range(1, 8)} == {"-"}


def test_spike_after_a_gap_compares_with_zero(spark):
    panel = bars(spark, [bar("A", 0, 5.0), bar("A", 1, 6.0), bar("A", 4, 1.0), bar("A", 5, 2.0)])
    got = by_day(build_indicators(panel))
    flags = {d: r.spike_vs_prev_day for d, r in got.items()}
    # day 0 and 4 have no previous calendar day; 2.0 is exactly twice 1.0, which is not above it
    assert flags == {day(0): 1, day(1): 0, day(4): 1, day(5): 0}


def test_missing_values_give_zero_and_dash(spark):
    panel = bars(spark, [bar("A", 0, ratio=None, close=None, prev=None, deliv=None)])
    built = build_indicators(panel)
    row = built.collect()[0]
    assert row.price_change is None and row.avg_close_1_days is None
    assert row.cmp_avg_p_signal1 == 0 and row.spike_vs_prev_day == 0
    assert bands(snapshot(panel, built)).collect()[0].band_t1 == "-"


def test_price_change_with_zero_or_missing_previous_close(spark):
    rows = [bar("A", 0, close=5.0, prev=0.0), bar("B", 0, close=5.0, prev=None)]
    got = {r.symbol: r for r in build_indicators(bars(spark, rows)).collect()}
    assert (got["A"].price_change, got["A"].pricechange_per) == (5.0, None)
    assert (got["B"].price_change, got["B"].pricechange_per) == (None, None)


def test_bands(spark):
    columns = ["ratio", "deliv_per"]
    columns += [f"avg_{m}_{k}_days" for m in ("ratio", "deliv") for k in range(1, 8)]
    averages = [1.0] * 14
    data = [(2.0, 2.0), (2.0, 0.5), (0.5, 2.0), (0.5, 0.5), (2.0, 1.0), (1.0, 2.0)]
    df = spark.createDataFrame([(*d, *averages) for d in data], columns)
    got = {(r.ratio, r.deliv_per): r.band_t4 for r in bands(df).collect()}
    assert [got[d] for d in data] == ["High", "Mid", "Low", "-", "-", "-"]


def test_top_two_with_ties(spark):
    data = [("x", v) for v in (10, 9, 9, 1)] + [("y", v) for v in (10, 10, 9)]
    data += [("z", None), ("z", 3)]
    df = spark.createDataFrame(data, "g string, v int")
    got = top2_flags(df, ["v"], ["g"]).filter("top2_v").select("g", "v").collect()
    assert sorted(map(tuple, got)) == [
        ("x", 9),
        ("x", 9),
        ("x", 10),
        ("y", 10),
        ("y", 10),
        ("z", 3),
    ]


def test_ladder_layout(spark):
    panel = bars(spark, [bar("A", n, ratio=n + 1.0, close=10.0 + n) for n in range(20)])
    snap = snapshot(panel, build_indicators(panel), symbols=["A"], dates=[day(19)])
    row, steps = snap.collect()[0], ladder(snap).orderBy("avg_days").collect()
    assert [s.avg_days for s in steps] == [1, 2, 3, 4, 5]
    assert steps[0].cmp == row.close_price and steps[0].volume == row.volume
    assert steps[4].cmp == row.avg_close_4_days and steps[4].ratio == row.avg_ratio_4_days
    assert [s.cmp_avg_p_signal for s in steps] == [1, 1, 1, 1, None]
    assert [s.period1 for s in steps] == [1, 2, 3, 4, None]
    assert [s.period2 for s in steps] == [1, 2, 3, None, None]
    assert steps[2].ratio2 == row.avg_ratio_7_days and steps[3].ratio2 is None


def test_history_window_and_order(spark):
    panel = bars(spark, [bar("A", n, ratio=n + 1.0) for n in range(0, 120, 5)])
    got = signal_history(panel, build_indicators(panel), day(115)).collect()
    assert [r.date1 for r in got] == [day(n) for n in range(115, 24, -5)]
    assert [r.top2_ratio for r in got][:3] == [True, True, False]


def test_marks_and_layout(spark):
    df = spark.createDataFrame(
        [("A", "SP", "-", 1, True), ("B", "-", "UP", None, False)],
        "symbol string, day2_3 string, volume_signal string, spike_vs_avg int, is_fno boolean",
    )
    got = {r.symbol: r for r in display_flags(df).collect()}
    a, b = got["A"], got["B"]
    assert (a.mark_day2_3, a.mark_volume_signal, a.mark_spike_vs_avg, a.mark_symbol) == (
        True,
        False,
        True,
        True,
    )
    assert (b.mark_day2_3, b.mark_volume_signal, b.mark_spike_vs_avg, b.mark_symbol) == (
        False,
        True,
        False,
        False,
    )
    laid = reindex(df, ["volume_signal", "symbol", "absent"])
    assert laid.columns == ["volume_signal", "symbol", "absent"]
    assert laid.filter(F.col("absent").isNotNull()).count() == 0

import datetime as dt
import random
from fractions import Fraction

import pytest

from eodscan.operators.frames import lookback, moving_averages, prev_day_value, recency_rank
from eodscan.plans import build_indicators
from eodscan.schemas import INDICATOR_COLUMNS
from tests.helpers import bar, bars, day

MEASURES = {"close_price": ("c", {1: 3, 2: 13}), "ratio": ("r", {1: 2, 7: 60})}


def gappy(seed, symbols=4, span=260):
    rng, rows = random.Random(seed), []
    for s in range(symbols):
        keep = rng.choice([0.15, 0.5, 0.95])
        for n in range(span):
            if rng.random() < keep:
                close = None if rng.random() < 0.1 else rng.randrange(1, 500_000) / 100
                rows.append(bar(f"S{s}", n, ratio=rng.randrange(1, 10**7) / 10**6, close=close))
    return rows


def brute(rows, column, n, lookback_days):
    """Mean of the last n rows of the symbol that are not older than the lookback."""
    names = [f.name for f in __import__("eodscan.schemas", fromlist=["BARS"]).BARS.fields]
    records = [dict(zip(names, r)) for r in rows]
    out = {}
    for me in records:
        first = me["date1"] - dt.timedelta(days=lookback_days)
        seen = [
            r
            for r in records
            if r["symbol"] == me["symbol"] and first <= r["date1"] <= me["date1"]
        ]
        values = [r[column] for r in sorted(seen, key=lambda r: r["date1"])[-n:]]
        exact = [Fraction(str(v)) for v in values if v is not None]
        out[me["symbol"], me["date1"]] = float(sum(exact) / len(exact)) if exact else None
    return out


@pytest.mark.parametrize("chunk_days", [60, 97, 512])
def test_averages_equal_brute_force(spark, chunk_days):
    rows = gappy(seed=chunk_days)
    got = moving_averages(bars(spark, rows), MEASURES, 60, chunk_days).collect()
    assert len(got) == len(rows)
    for column, (stem, tiers) in MEASURES.items():
        for k, n in tiers.items():
            want = brute(rows, column, n, 60)
            for r in got:
                assert r[f"{stem}_{k}_days"] == want[r.symbol, r.date1]


def test_chunk_must_cover_the_lookback(spark):
    with pytest.raises(ValueError):
        moving_averages(bars(spark, []), MEASURES, 60, 30)


def test_every_date_equals_one_date_builds(spark):
    panel = bars(spark, gappy(seed=5, symbols=2, span=90))
    every = build_indicators(panel)
    days = [day(0), day(31), day(61), day(89)]
    together = {tuple(r) for r in every.filter(every.date1.isin(days)).collect()}
    assert {tuple(r) for r in build_indicators(panel, days).collect()} == together
    single = set()
    for d in days:
        single |= {tuple(r) for r in build_indicators(panel, d).collect()}
    assert single == together
    assert every.columns == INDICATOR_COLUMNS


def test_previous_calendar_day(spark):
    rows = [bar("A", 0, 1.0), bar("A", 1, 2.0), bar("A", 3, 3.0), bar("B", 2, 9.0)]
    for chunk_days in (1, 512):
        got = prev_day_value(bars(spark, rows), "ratio", chunk_days=chunk_days).collect()
        seen = {(r.symbol, r.date1): r.prev_ratio for r in got}
        assert seen == {
            ("A", day(0)): None,
            ("A", day(1)): 1.0,
            ("A", day(3)): None,
            ("B", day(2)): None,
        }


def test_lookback_of_several_dates(spark):
    panel = bars(spark, [bar("A", n) for n in range(0, 100, 10)])
    one = lookback(panel, day(50), 20).select("as_of", "date1").collect()
    assert {(r.as_of, r.date1) for r in one} == {(day(50), day(n)) for n in (30, 40, 50)}
    many = lookback(panel, [day(50), day(60)], 20).select("as_of", "date1").collect()
    want = {(day(a), day(n)) for a in (50, 60) for n in range(a - 20, a + 1, 10)}
    assert {(r.as_of, r.date1) for r in many} == want
    ranked = recency_rank(lookback(panel, day(50), 20)).collect()
    assert {r.date1: r.rn for r in ranked} == {day(50): 1, day(40): 2, day(30): 3}

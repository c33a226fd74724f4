"""Small hand-made panels."""

import datetime as dt

from eodscan.schemas import BARS

DAY0 = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    return DAY0 + dt.timedelta(days=n)


def bar(symbol, n, ratio=1.0, close=10.0, prev=10.0, turnover=100.0, deliv=50.0, series="EQ"):
    values = {
        "symbol": symbol,
        "series": series,
        "date1": day(n),
        "prev_close": prev,
        "close_price": close,
        "avg_price": close,
        "turnover_lacs": turnover,
        "ttl_trd_qnty": 100.0,
        "no_of_trades": 10,
        "deliv_qty": 5,
        "deliv_per": deliv,
        "ratio": ratio,
    }
    return tuple(values.get(f.name) for f in BARS.fields)


def bars(spark, rows):
    return spark.createDataFrame(rows, BARS)


def ledger(spark, *ns):
    return spark.createDataFrame([(day(n),) for n in ns], "date1 date")

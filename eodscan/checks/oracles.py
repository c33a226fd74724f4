"""Plain SQL for every query, written for DuckDB over the same tables.

The SQL states each definition directly (a moving average is a self join over the lookback and a
row count), not the way the Spark job computes it.
"""

from __future__ import annotations

from eodscan.checks.settings import LADDER_SYMBOLS, LAST_DAY, LINK_BASE, RANGE_END, RANGE_START, SPINE_END, SPINE_START
from eodscan.fixtures import LEDGER_CUTOFF
from eodscan.plans import HISTORY_LABELS, HOT_CAKE_LABELS, LADDER_LABELS
from eodscan.schemas import (
    HISTORY_LOOKBACK,
    INDICATOR_LOOKBACK,
    LONG_TIERS,
    MEASURES,
    SCREEN_LOOKBACK,
    SHORT_TIERS,
    TREND_FLAGS,
    UPLOAD_LOOKBACK,
    average_column,
    average_columns,
    trend_columns,
)

_JOINS = {
    "s_name": "JOIN supplier ON s_suppkey = l_suppkey",
    "n_name": "JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey",
    "r_name": "JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"
    " JOIN region ON r_regionkey = n_regionkey",
}

LEDGER = f"""ledger AS (
  SELECT DISTINCT CAST(l_shipdate AS DATE) AS date1 FROM lineitem
  WHERE CAST(l_shipdate AS DATE) < DATE '{LEDGER_CUTOFF}')"""
ALL_DAYS = "ledger AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date1 FROM lineitem)"
MONTHS = ALL_DAYS + """,
as_ofs AS (SELECT max(date1) AS as_of FROM ledger GROUP BY date_trunc('month', date1))"""


def d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def quotient(expr: str) -> str:
    """Six decimals, rounded by plain double arithmetic."""
    return f"CAST(floor({expr} * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS DECIMAL(18,6))"


def bars(grain: str = "s_name", period: str = "day") -> str:
    key = "symbol, series, date1"
    order = ["l_orderkey", "l_linenumber", "l_partkey", "p", "q"]
    up, down = ", ".join(order), ", ".join(f"{c} DESC" for c in order)
    return f"""lines AS (
  SELECT {grain} AS symbol, CASE WHEN l_returnflag = 'A' THEN ' BE' ELSE ' EQ' END AS series,
    CAST(date_trunc('{period}', l_shipdate) AS DATE) AS date1, CAST(l_quantity AS DECIMAL(18,4)) AS q,
    CAST(l_extendedprice AS DECIMAL(18,4)) AS p, l_linestatus, l_orderkey, l_linenumber, l_partkey
  FROM lineitem {_JOINS[grain]}),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {up}) AS nth,
    row_number() OVER (PARTITION BY {key} ORDER BY {down}) AS nth_last
  FROM lines),
daily AS (
  SELECT {key}, count(*) AS n, sum(q) AS q, sum(p) AS t,
    sum(CASE WHEN l_linestatus = 'F' THEN q END) AS dq,
    max(CASE WHEN nth = 1 THEN p END) AS open_price,
    max(CASE WHEN nth_last = 1 THEN p END) AS close_price,
    min(p) AS low_price, max(p) AS high_price
  FROM placed GROUP BY {key}),
bars AS (
  SELECT {key}, lag(close_price) OVER (PARTITION BY symbol, series ORDER BY date1) AS prev_close,
    open_price, high_price, low_price, close_price AS last_price, close_price,
    {quotient(f"{d('t')} / {d('q')}")} AS avg_price,
    CAST(q AS DECIMAL(18,4)) AS ttl_trd_qnty, CAST(t AS DECIMAL(18,4)) AS turnover_lacs,
    n AS no_of_trades, CAST(dq AS BIGINT) AS deliv_qty,
    {quotient(f"{d('dq')} / {d('q')} * 100")} AS deliv_per,
    {quotient(f"{d('q')} / {d('n')}")} AS ratio
  FROM daily),
eq AS (
  SELECT *, {d("close_price - prev_close")} AS price_change,
    ({d("close_price")} - {d("prev_close")}) / NULLIF({d("prev_close")}, 0) * 100
      AS pricechange_per
  FROM bars WHERE trim(series) = 'EQ')"""


def mean(col: str, condition: str = "TRUE") -> str:
    x = f"CASE WHEN {condition} THEN CAST({col} AS DECIMAL(22,6)) END"
    return (
        f"CAST(CAST(sum({x}) * 1000000 AS HUGEINT) AS DOUBLE)"
        f" / (NULLIF(count({x}), 0) * 1000000)"
    )


def means(measures: dict = MEASURES, lookback: int = INDICATOR_LOOKBACK) -> str:
    """CTEs back_rows and means: averages of each EQ row over its own lookback."""
    listed = ", ".join(f"b.{m}" for m in measures)
    averages = ",\n    ".join(
        f"{mean(m, f'back <= {n}')} AS {average_column(stem, k)}"
        for m, (stem, tiers) in measures.items()
        for k, n in tiers.items()
    )
    return f"""back_rows AS (
  SELECT a.symbol, a.series, a.date1, b.date1 AS that_date, b.ratio AS that_ratio, {listed},
    row_number() OVER (PARTITION BY a.symbol, a.date1 ORDER BY b.date1 DESC) AS back
  FROM eq a JOIN eq b
    ON b.symbol = a.symbol AND b.date1 BETWEEN a.date1 - {lookback} AND a.date1),
means AS (
  SELECT symbol, series, date1,
    max(CASE WHEN that_date = date1 - 1 THEN that_ratio END) AS prev_ratio,
    {averages}
  FROM back_rows GROUP BY symbol, series, date1)"""


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _trend_sql() -> str:
    out = []
    for measure, stem in TREND_FLAGS.items():
        averages = MEASURES[measure][0]
        links = [d(f"e.{measure}")] + [f"m.{average_column(averages, k)}" for k in SHORT_TIERS]
        out += [f"{_flag(f'{links[k - 1]} > {links[k]}')} AS {stem}{k}" for k in SHORT_TIERS]
    return ",\n    ".join(out)


_SPIKES = f"""{_flag(f"{d('e.ratio')} > m.avg_ratio_7_days * 2")} AS spike_vs_avg,
    {_flag("e.ratio > coalesce(m.prev_ratio, 0) * 2")} AS spike_vs_prev_day"""


def indicators(grain: str = "s_name", period: str = "day", stored: bool = False) -> str:
    """stored: the prices come from a table of doubles, so their difference is one of doubles."""
    change = f"{d('e.close_price')} - {d('e.prev_close')} AS price_change" if stored else "e.price_change"
    return f"""{bars(grain, period)},
{means()},
indicators AS (
  SELECT e.symbol, e.series, e.date1, {change}, e.pricechange_per,
    {", ".join(f"m.{c}" for c in average_columns())},
    {_trend_sql()},
    {_SPIKES}
  FROM eq e JOIN means m ON m.symbol = e.symbol AND m.date1 = e.date1)"""


def _moving(measure: str, grain: str) -> str:
    part = {measure: MEASURES[measure]}
    cols = ", ".join(average_columns(part))
    return f"WITH {bars(grain)}, {means(part)} SELECT symbol, date1, {cols} FROM means"


# grain of each one-measure query: some sparse, some dense enough to fill the long frames
MOVING = {
    "moving_avg_close": ("close_price", "s_name"),
    "moving_avg_avgprice": ("avg_price", "n_name"),
    "moving_avg_delivery": ("deliv_per", "r_name"),
    "moving_avg_ratio": ("ratio", "r_name"),
    "moving_avg_turnover": ("turnover_lacs", "n_name"),
    "moving_avg_change": ("price_change", "r_name"),
    "moving_avg_changepct": ("pricechange_per", "s_name"),
}

TWENTY = {"turnover_lacs": ("avg_turnover", {20: 20})}
TWO_ROWS = {
    "close_price": ("avg_close", {2: 2}),
    "deliv_per": ("avg_delivery", {2: 2}),
    "ratio": ("avg_ratio", {2: 2}),
    "ttl_trd_qnty": ("avg_ttl_trd_qnty", {2: 2}),
}


def _trailing(measures: dict, grain: str) -> str:
    cols = ", ".join(average_columns(measures))
    return (
        f"WITH {bars(grain)}, {means(measures, SCREEN_LOOKBACK)} SELECT symbol, date1, {cols} FROM means"
    )


def pivot(by: str) -> str:
    def at(k: int, c: str) -> str:
        return f"max(CASE WHEN rn = {k} THEN {c} END)"

    return f"""looked AS (
  SELECT a.as_of, e.*, row_number() OVER (PARTITION BY a.as_of, e.symbol ORDER BY e.date1 DESC) AS rn
  FROM as_ofs a JOIN eq e ON e.date1 BETWEEN a.as_of - {SCREEN_LOOKBACK} AND a.as_of),
pivoted AS (
  SELECT as_of, {by}, {at(1, "date1")} AS last_date, {at(1, "close_price")} AS close_today,
    {at(1, "ratio")} AS ratio_today, {at(2, "ratio")} AS ratio_prev_row,
    {at(1, "prev_close")} AS prev_close, {at(1, "turnover_lacs")} AS turnover_today,
    {at(1, "deliv_per")} AS delivery_today,
    {mean("turnover_lacs", "rn <= 20")} AS avg_turnover_20_days,
    {mean("close_price", "rn <= 2")} AS pair_close, {mean("deliv_per", "rn <= 2")} AS pair_delivery,
    {mean("ratio", "rn <= 2")} AS pair_ratio, {mean("ttl_trd_qnty", "rn <= 2")} AS pair_quantity
  FROM looked GROUP BY as_of, {by})"""


def screen(spike: str) -> str:
    """Columns shared by both screens; percentages are rounded in whole numbers."""
    now, before = ("CAST({} * 10000 AS HUGEINT)".format(c) for c in ("close_today", "prev_close"))
    hundredths = (
        f"sign({now} - {before}) * ((2 * abs({now} - {before}) * 10000 + {before}) // (2 * {before}))"
    )
    return f"""screened AS (
  SELECT *,
    CASE WHEN ratio_prev_row IS NOT NULL AND ratio_today > ratio_prev_row * 3
      THEN '{spike}' ELSE '-' END AS day2_3,
    CASE WHEN ratio_prev_row IS NOT NULL AND ratio_today > ratio_prev_row * 5
      THEN '{spike}' ELSE '-' END AS day2_5,
    {d("round(close_today, 2)")} AS current_price,
    CASE WHEN prev_close <> 0 THEN {d(hundredths)} / 100 END AS change_of_percent,
    CASE WHEN {d("turnover_today")} > avg_turnover_20_days THEN 'UP' ELSE '-' END AS volume_signal,
    CASE WHEN {d("turnover_today")} > avg_turnover_20_days * 2 THEN 'High' ELSE '-' END
      AS highvol_signal
  FROM pivoted)"""


_CHANGE_TEXT = """CASE WHEN prev_close IS NULL THEN 'N/A'
      WHEN change_of_percent IS NOT NULL THEN printf('%.2f', change_of_percent) END AS change_text"""


def dashboard_select() -> str:
    return f"""SELECT as_of, row_number() OVER (PARTITION BY as_of ORDER BY symbol) AS sr_no, symbol,
    last_date, day2_3, day2_5, current_price, change_of_percent, {_CHANGE_TEXT},
    avg_turnover_20_days, {d("turnover_today")} AS turnover_today, volume_signal, highvol_signal,
    {d("close_today")} AS close_price1, pair_close AS close_price2,
    {d("delivery_today")} AS delivery1_percent, pair_delivery AS delivery2_percent,
    {d("ratio_today")} AS ratio1, pair_ratio AS ratio2, pair_close AS avg_price1,
    pair_close AS avg_price2, {d("turnover_today")} AS volume1, pair_quantity AS volume2
  FROM screened"""


HOT_FLAGS = "cmp_avg_p_signal1, avg_p_signal1, percent_delivery_signal1, ratio_signal1," + (
    " spike_vs_avg, spike_vs_prev_day"
)
HOT_AVERAGES = ", ".join(
    average_column(s, k) for s in ("avg_deliv", "avg_ratio") for k in LONG_TIERS
)
FNO = "fno AS (SELECT s_name AS symbol FROM supplier WHERE s_acctbal > 0)"


def hot_cake() -> str:
    return f"""WITH {indicators()}, {MONTHS}, {pivot("symbol, series")}, {screen("SP")}, {FNO}
  SELECT s.as_of, s.symbol, s.last_date, day2_3, day2_5, current_price, change_of_percent,
    {_CHANGE_TEXT}, avg_turnover_20_days, {d("turnover_today")} AS turnover_today, volume_signal,
    highvol_signal, {HOT_FLAGS}, {HOT_AVERAGES},
    s.symbol IN (SELECT symbol FROM fno) AS is_fno
  FROM screened s LEFT JOIN indicators i
    ON i.symbol = s.symbol AND i.series = s.series AND i.date1 = s.last_date
  WHERE day2_3 = 'SP' OR day2_5 = 'SP'"""


def _joined(facts: list[str]) -> str:
    cols = ", ".join(f"{d(f'b.{c}')} AS {'volume' if c == 'turnover_lacs' else c}" for c in facts)
    return f"""joined AS (
  SELECT i.*, {cols}
  FROM indicators i JOIN bars b
    ON b.symbol = i.symbol AND b.series = i.series AND b.date1 = i.date1)"""


_FACTS = ["close_price", "prev_close", "deliv_per", "ratio", "turnover_lacs", "avg_price"]


def snapshot(grain: str) -> str:
    return f"WITH {indicators(grain)}, {_joined(_FACTS)}"


_SNAPSHOT_COLUMNS = ", ".join(
    [
        "symbol, series, date1, close_price, prev_close, deliv_per, ratio, avg_price, volume",
        "price_change, pricechange_per",
        *average_columns(),
        *trend_columns(),
    ]
)


def ladder(grain: str) -> str:
    values = {
        "cmp": ("close_price", "avg_close"),
        "avg_price": ("avg_price", "avg_avgpri"),
        "price_change": ("price_change", "avg_prichange"),
        "pct_change": ("pricechange_per", "avg_pricechange_per"),
        "pct_delivery": ("deliv_per", "avg_deliv"),
        "ratio": ("ratio", "avg_ratio"),
        "volume": ("volume", "avg_vol"),
    }
    steps = []
    for n in range(1, 6):
        cols = [f"{n} AS avg_days"]
        for name, (today, stem) in values.items():
            cols.append(f"{today if n == 1 else average_column(stem, n - 1)} AS {name}")
        for stem in TREND_FLAGS.values():
            cols.append(f"{f'{stem}{n}' if n <= 4 else 'NULL'} AS {stem}")
        cols += [
            f"{n if n <= 4 else 'NULL'} AS period1",
            f"{f'avg_deliv_{n}_days' if n <= 4 else 'NULL'} AS delivery1_pct",
            f"{f'avg_ratio_{n}_days' if n <= 4 else 'NULL'} AS ratio1",
            f"{n if n <= 3 else 'NULL'} AS period2",
            f"{f'avg_deliv_{n + 4}_days' if n <= 3 else 'NULL'} AS delivery2_pct",
            f"{f'avg_ratio_{n + 4}_days' if n <= 3 else 'NULL'} AS ratio2",
        ]
        steps.append(f"SELECT symbol, date1, {', '.join(cols)} FROM joined")
    return snapshot(grain) + "\n" + "\nUNION ALL\n".join(steps)


def band(k: int) -> str:
    r, v = f"avg_ratio_{k}_days", f"avg_deliv_{k}_days"
    return (
        f"CASE WHEN ratio > {r} AND deliv_per > {v} THEN 'High'"
        f" WHEN ratio > {r} AND deliv_per < {v} THEN 'Mid'"
        f" WHEN ratio < {r} AND deliv_per > {v} THEN 'Low' ELSE '-' END AS band_t{k}"
    )


BANDS = ",\n    ".join(band(k) for k in LONG_TIERS)


def top2(c: str) -> str:
    return (
        f"({c} IS NOT NULL AND rank() OVER (PARTITION BY as_of, symbol"
        f" ORDER BY {c} DESC NULLS LAST) <= 2) AS top2_{c}"
    )


HIGHLIGHTED = ["deliv_per", "ratio", "deliv_qty", "volume"]


def history_ctes(grain: str) -> str:
    return f"""WITH {indicators(grain)}, {_joined([*_FACTS, "deliv_qty"])}, {MONTHS},
history AS (
  SELECT a.as_of, j.* FROM as_ofs a JOIN joined j
    ON j.date1 BETWEEN a.as_of - {HISTORY_LOOKBACK} AND a.as_of)"""


HISTORY_SELECT = f"""SELECT as_of, symbol, date1, prev_close, close_price, avg_price, price_change,
    pricechange_per, deliv_per, ratio, CAST(deliv_qty AS BIGINT) AS deliv_qty, volume,
    {BANDS}, spike_vs_avg, spike_vs_prev_day,
    {", ".join(top2(c) for c in HIGHLIGHTED)}
  FROM history"""

BAR_NUMBERS = [
    "prev_close",
    "open_price",
    "high_price",
    "low_price",
    "last_price",
    "close_price",
    "avg_price",
    "ttl_trd_qnty",
    "turnover_lacs",
    "deliv_per",
]
_TYPED_NUMBERS = ", ".join(f"{d(c)} AS {c}" for c in BAR_NUMBERS)
# rows the file queries spoil on purpose, and why the loader must refuse them
BAD_CLOSE = "no_of_trades = 1 AND CAST(ttl_trd_qnty AS INTEGER) % 10 = 0"


def _typed_bars(where: str = "TRUE") -> str:
    return f"""SELECT symbol, trim(series) AS series, date1, {_TYPED_NUMBERS}, no_of_trades, deliv_qty,
    {d("ttl_trd_qnty")} / no_of_trades AS unit_ratio
  FROM bars WHERE {where}"""


LADDER_MARKED = list(TREND_FLAGS.values())


def _as_shown(labels: dict[str, str]) -> str:
    return ", ".join(f'{column} AS "{label}"' for column, label in labels.items())


def oracle_sql() -> dict[str, str]:
    sql = {
        "unit_ratio": f"""WITH {bars()} SELECT symbol, series, date1,
            {d("ttl_trd_qnty")} / NULLIF(no_of_trades, 0) AS unit_ratio FROM bars""",
        "price_change": f"""WITH {bars("n_name")} SELECT symbol, date1, price_change, pricechange_per
            FROM eq""",
        "series_split": f"""WITH {bars()} SELECT trim(series) AS series,
            CASE WHEN trim(series) = 'EQ' THEN 'bars' ELSE 'bars_other' END AS goes_to,
            date1, count(*) AS n FROM bars GROUP BY ALL""",
        "lookback_filter": f"""WITH {bars()}, {MONTHS},
            spans AS (SELECT * FROM (VALUES (60), (65), (90)) t(days))
            SELECT a.as_of, s.days, count(*) AS n_rows, min(e.date1) AS first_date
            FROM as_ofs a, spans s, eq e WHERE e.date1 BETWEEN a.as_of - s.days AND a.as_of
            GROUP BY a.as_of, s.days""",
        "recency_rank": f"""WITH {bars()}, {MONTHS}
            SELECT a.as_of, e.symbol, e.date1,
              row_number() OVER (PARTITION BY a.as_of, e.symbol ORDER BY e.date1 DESC) AS rn
            FROM as_ofs a JOIN eq e ON e.date1 BETWEEN a.as_of - {SCREEN_LOOKBACK} AND a.as_of""",
        **{name: _moving(m, grain) for name, (m, grain) in MOVING.items()},
        "moving_avg_all_dates": f"""WITH {bars("n_name")}, {means()}
            SELECT symbol, date1, {", ".join(average_columns())} FROM means""",
        "turnover_avg20": _trailing(TWENTY, "n_name"),
        "two_row_avgs": _trailing(TWO_ROWS, "s_name"),
        "prev_day_ratio": f"""WITH {bars()}
            SELECT a.symbol, a.date1, {d("a.ratio")} AS ratio, {d("p.ratio")} AS prev_ratio
            FROM eq a LEFT JOIN eq p ON p.symbol = a.symbol AND p.date1 = a.date1 - 1""",
        "tier_signals": f"""WITH {indicators("n_name")}
            SELECT symbol, date1, {", ".join(trend_columns())} FROM indicators""",
        "spike_signals": f"""WITH {indicators()}
            SELECT symbol, date1, spike_vs_avg, spike_vs_prev_day FROM indicators""",
        "indicator_build": f"WITH {indicators()} SELECT * FROM indicators",
        "indicator_dates": f"""WITH {indicators("r_name")}, {MONTHS}
            SELECT * FROM indicators WHERE date1 IN (SELECT as_of FROM as_ofs)""",
        "pivot_latest": f"""WITH {bars()}, {MONTHS}, {pivot("symbol")}
            SELECT as_of, symbol, last_date, {d("close_today")} AS close_today,
              {d("ratio_today")} AS ratio_today, {d("ratio_prev_row")} AS ratio_prev_row,
              {d("prev_close")} AS prev_close, {d("turnover_today")} AS turnover_today,
              {d("delivery_today")} AS delivery_today, avg_turnover_20_days, pair_close,
              pair_delivery, pair_ratio, pair_quantity FROM pivoted""",
        "dashboard": f"""WITH {bars()}, {MONTHS}, {pivot("symbol")}, {screen("SPT")}
            {dashboard_select()}""",
        "dashboard_one_date": f"""WITH {bars("n_name")},
            ledger AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date1 FROM lineitem),
            as_ofs AS (SELECT max(date1) AS as_of FROM ledger), {pivot("symbol")}, {screen("SPT")}
            {dashboard_select()}""",
        "hot_cake": hot_cake(),
        "fno_flag": f"""WITH {bars()}, {FNO}
            SELECT symbol, series, date1, symbol IN (SELECT symbol FROM fno) AS is_fno FROM bars""",
        "symbol_snapshot": snapshot("s_name") + f" SELECT {_SNAPSHOT_COLUMNS} FROM joined",
        "ladder": ladder("n_name"),
        "symbol_filter": f"""SELECT * FROM ({ladder("n_name")}) WHERE symbol IN
            ({", ".join(f"'{x}'" for x in LADDER_SYMBOLS)}) AND date1 = DATE '{LAST_DAY}'""",
        "bands": f"{snapshot('n_name')} SELECT symbol, date1, {BANDS} FROM joined",
        "top2_flags": f"""{history_ctes("s_name")} SELECT as_of, symbol, date1,
            {", ".join(top2(c) for c in HIGHLIGHTED)} FROM history""",
        "signal_history": f"{history_ctes('s_name')} {HISTORY_SELECT}",
        "display_flags": f"""WITH hot AS ({hot_cake()})
            SELECT as_of, symbol, day2_3 = 'SP' AS mark_day2_3, day2_5 = 'SP' AS mark_day2_5,
              volume_signal = 'UP' AS mark_volume_signal,
              highvol_signal = 'High' AS mark_highvol_signal,
              {", ".join(f"coalesce({c.strip()} = 1, FALSE) AS mark_{c.strip()}" for c in HOT_FLAGS.split(","))},
              is_fno AS mark_symbol FROM hot""",
        "history_marks": f"""{snapshot("r_name")}, banded AS (
              SELECT symbol, date1, spike_vs_avg, spike_vs_prev_day, {BANDS} FROM joined)
            SELECT symbol, date1, spike_vs_avg = 1 AS mark_spike_vs_avg,
              spike_vs_prev_day = 1 AS mark_spike_vs_prev_day,
              {", ".join(f"band_t{k} <> '-' AS mark_band_t{k}" for k in LONG_TIERS)} FROM banded""",
        "display_names": f"""WITH {bars()}, {MONTHS}, {pivot("symbol")}, {screen("SPT")},
            shown AS ({dashboard_select()})
            SELECT sr_no AS "Sr.No", symbol AS "Symbol", day2_3 AS "Day23", day2_5 AS "Day25",
              current_price AS "Cur Price", change_of_percent AS "% Change",
              avg_turnover_20_days AS "Avg1 Vol", turnover_today AS "Vol",
              volume_signal AS "Vol Sgnl", highvol_signal AS "HVol Sgnl",
              close_price1 AS "Cl Pri1", close_price2 AS "Cl Pri2",
              delivery1_percent AS "Delvry1 %", delivery2_percent AS "Delvry2 %",
              ratio1 AS "Ratio1", ratio2 AS "Ratio2", avg_price1 AS "Avg Pri1", avg_price2 AS "Avg Pri2",
              volume1 AS "Volume1", volume2 AS "Volume2" FROM shown""",
        "column_layout": f"""WITH {indicators("r_name")}
            SELECT date1, symbol, price_change, CAST(NULL AS VARCHAR) AS remark FROM indicators""",
        "parameterised_sql": f"""WITH {bars()}, ranked AS (
              SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date1 DESC) AS rn FROM eq
              WHERE date1 BETWEEN DATE '{LAST_DAY}' - 65 AND DATE '{LAST_DAY}')
            SELECT symbol, max(CASE WHEN rn = 1 THEN date1 END) AS last_date,
              {d("max(CASE WHEN rn = 1 THEN ratio END)")} AS ratio_today,
              {d("max(CASE WHEN rn = 2 THEN ratio END)")} AS ratio_prev_row
            FROM ranked GROUP BY symbol""",
        "symbol_list": f"WITH {bars()} SELECT DISTINCT symbol FROM eq",
        "date_available": f"""WITH {LEDGER}
            SELECT DISTINCT CAST(o_orderdate AS DATE) AS date1 FROM orders
            WHERE CAST(o_orderdate AS DATE) IN (SELECT date1 FROM ledger)""",
        "coverage_gaps": f"""WITH {LEDGER}, spine AS (
              SELECT CAST(unnest(generate_series(DATE '{SPINE_START}', DATE '{SPINE_END}',
                INTERVAL 1 DAY)) AS DATE) AS date1)
            SELECT date1 FROM spine WHERE date1 NOT IN (SELECT date1 FROM ledger)""",
        "new_dates_only": f"""WITH {bars()}, {LEDGER}
            SELECT symbol, series, date1 FROM bars WHERE date1 NOT IN (SELECT date1 FROM ledger)""",
        "alpha_first_sort": f"""WITH names AS (
              SELECT n_name AS symbol FROM nation UNION ALL SELECT c_name FROM customer
              UNION ALL SELECT CAST(c_custkey AS VARCHAR) || c_mktsegment FROM customer)
            SELECT CASE WHEN regexp_matches(symbol, '^[A-Za-z]') THEN 1 ELSE 2 END AS bucket, symbol
            FROM names""",
        "deep_link": f"""WITH {bars()}
            SELECT symbol, date1, '{LINK_BASE}/?symbol=' || url_encode(symbol) || '&date=' ||
              strftime(date1, '%Y-%m-%d') AS link FROM eq""",
        "events_panel": f"""WITH eq AS (
              SELECT user_id AS symbol, ' EQ' AS series, CAST(ts AS DATE) AS date1,
                sum(CAST(value AS DECIMAL(18,4))) AS value, 0 AS ratio
              FROM events GROUP BY user_id, CAST(ts AS DATE)),
            {means({"value": ("avg_value", SHORT_TIERS)})}
            SELECT symbol, date1, {", ".join(f"avg_value_{k}_days" for k in SHORT_TIERS)}
            FROM means""",
        "csv_round_trip": f"WITH {bars()} {_typed_bars(f'NOT ({BAD_CLOSE})')}",
        "mixed_headers": f"WITH {bars('n_name')} {_typed_bars()}",
        "many_paths": f"WITH {bars('r_name')} {_typed_bars()}",
        "quoted_breaks": f"""WITH {bars('n_name')} SELECT * REPLACE
            (CASE WHEN no_of_trades % 2 = 1 THEN symbol || chr(10) || 'and, "more"' ELSE symbol END AS symbol)
            FROM ({_typed_bars()})""",
        "folder_range": f"""WITH {bars('r_name')} {_typed_bars(f"day(date1) <= 2 AND date1 BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'")}""",
        "zip_files": f"WITH {bars('r_name')} {_typed_bars()}",
        "upload_span": f"""WITH {MONTHS} SELECT as_of AS end_date, date1 FROM as_ofs JOIN ledger
            ON date1 BETWEEN as_of - {UPLOAD_LOOKBACK} AND as_of""",
        "ladder_marks": f"""SELECT symbol, date1, avg_days, {", ".join(f"coalesce({c} = 1, FALSE) AS mark_{c}" for c in LADDER_MARKED)}
            FROM ({ladder("n_name")})""",
        "hot_cake_names": f"SELECT as_of, {_as_shown(HOT_CAKE_LABELS)} FROM ({hot_cake()})",
        "ladder_names": f"SELECT symbol, date1, {_as_shown(LADDER_LABELS)} FROM ({ladder('r_name')})",
        "history_names": f"SELECT as_of, symbol, {_as_shown(HISTORY_LABELS)} FROM ({history_ctes('r_name')} {HISTORY_SELECT})",
        "csv_rejects": f"""WITH {bars()} SELECT 'bad number in close_price' AS reason, date1,
            count(*) AS n FROM bars WHERE {BAD_CLOSE} GROUP BY date1""",
        "text_scan": f"WITH {bars('n_name')} {_typed_bars()}",
        "zip_round_trip": f"WITH {bars('n_name')} {_typed_bars()}",
        "load_days": f"""WITH {bars("n_name", "month")}
            SELECT 'bars' AS table_name, date1, count(*) AS n FROM eq GROUP BY date1
            UNION ALL SELECT 'bars_other', date1, count(*) FROM bars WHERE trim(series) <> 'EQ'
            GROUP BY date1
            UNION ALL SELECT 'indicators', date1, count(*) FROM eq GROUP BY date1
            UNION ALL SELECT 'load_ledger', date1, 1 FROM bars GROUP BY date1""",
        "duplicate_rows": f"""WITH {bars("r_name")} SELECT symbol, trim(series) AS series, date1,
            no_of_trades AS copies FROM bars""",
        "append_inferred": f"""WITH {bars("r_name")} SELECT symbol, date1, 2 * no_of_trades AS trades
            FROM eq""",
        "incremental_ingest": f"WITH {indicators('n_name', 'month', True)} SELECT * REPLACE (trim(series) AS series) FROM indicators",
        "split_days_stream": f"WITH {indicators('n_name', 'month', True)} SELECT * REPLACE (trim(series) AS series) FROM indicators",
        "late_load": f"WITH {indicators('n_name', 'month', True)} SELECT * REPLACE (trim(series) AS series) FROM indicators",
    }
    return sql

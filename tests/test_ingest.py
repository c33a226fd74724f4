import uuid
import zipfile

import pytest

from eodscan.functions.dates import file_name_for
from eodscan.plans import build_indicators
from eodscan.sources import (
    append_inferred,
    bootstrap,
    load_days,
    load_folder,
    read_daily,
    read_daily_text,
    read_daily_zip,
)
from eodscan.streaming import stream_days
from tests.helpers import bar, bars, day

NAMES = [
    "SYMBOL",
    "SERIES",
    "DATE1",
    "PREV_CLOSE",
    "OPEN_PRICE",
    "HIGH_PRICE",
    "LOW_PRICE",
    "LAST_PRICE",
    "CLOSE_PRICE",
    "AVG_PRICE",
    "TTL_TRD_QNTY",
    "TURNOVER_LACS",
    "NO_OF_TRADES",
    "DELIV_QTY",
    "DELIV_PER",
]
HEADER = ", ".join(NAMES)


def line(symbol="A", series=" EQ", n=0, close="10.5", trades="4", qty="10", deliv="50.0", date=None):
    date = date or f" {day(n):%d-%b-%Y}"
    return f"{symbol},{series},{date},10,10,11,9,10,{close},10.2,{qty},1.5,{trades},5,{deliv}"


def text(*lines, header=HEADER):
    return "\n".join([header, *lines]) + "\n"


def write_day(folder, n, *lines, header=HEADER):
    folder.mkdir(exist_ok=True)
    (folder / file_name_for(day(n))).write_text(text(*lines, header=header))


def new_tables(spark, tmp_path):
    return bootstrap(spark, f"t_{uuid.uuid4().hex[:8]}", str(tmp_path / "db"))


def rows(df):
    return sorted(map(str, df.collect()))


MIXED = [
    line("GOOD"),
    line("ZERO", trades="0"),
    line("OTHER", series=" BE", deliv=" -"),
    line("BADNUM", close="ten"),
    line("NOTNUM", close="NaN"),
    line("BADDATE", date="2024-01-01"),
    line("TWICE"),
    line("TWICE"),
    line("TWICE", close="99"),
]


def check_mixed(good, rejects):
    seen = {r.symbol: r for r in good.collect()}
    assert sorted(seen) == ["GOOD", "NOTNUM", "OTHER", "TWICE", "ZERO"]
    assert (seen["GOOD"].series, seen["GOOD"].date1, seen["GOOD"].ratio) == ("EQ", day(0), 2.5)
    assert seen["ZERO"].ratio is None and seen["OTHER"].deliv_per is None
    assert seen["NOTNUM"].close_price is None and seen["TWICE"].close_price == 10.5
    refused = {}
    for r in rejects.collect():
        refused[r.reason] = refused.get(r.reason, 0) + r.copies
    assert refused["bad number in close_price"] == 1
    assert refused["bad date in date1"] == 1
    assert refused["duplicate key"] == 2


def test_csv_file(spark, tmp_path):
    write_day(tmp_path / "in", 0, *[m + ",x" for m in MIXED], header=HEADER + ", EXTRA")
    good, rejects = read_daily(spark, str(tmp_path / "in"))
    check_mixed(good, rejects)
    assert rejects.filter("reason = 'column dropped: extra'").count() == 1


def test_bad_numbers_can_be_kept_as_null(spark, tmp_path):
    write_day(tmp_path / "in", 0, *MIXED)
    good, rejects = read_daily(spark, str(tmp_path / "in"), bad_values="null")
    assert good.filter("symbol = 'BADNUM' and close_price is null").count() == 1
    assert rejects.filter("reason = 'kept as null: bad number in close_price'").count() == 1


def test_text_column_and_archive_give_the_same_rows(spark, tmp_path):
    df = spark.createDataFrame([("a.csv", text(*MIXED)), ("b", ""), ("c", "no,header\n1,2\n")])
    good, rejects = read_daily_text(df, "_2", "_1")
    check_mixed(good, rejects)
    assert rejects.filter("reason like 'no usable header%'").count() == 1

    folder = tmp_path / "zips"
    folder.mkdir()
    with zipfile.ZipFile(folder / "day.zip", "w") as z:
        z.writestr("notes.txt", "x")
        z.writestr("DAY.CSV", text(*MIXED))
        z.writestr("SECOND.CSV", text(line("IGNORED")))
    with zipfile.ZipFile(folder / "lower.zip", "w") as z:
        z.writestr("day.csv", text(line("LOWER")))
    (folder / "broken.zip").write_bytes(b"not an archive")
    zipped, refused = read_daily_zip(spark, str(folder))
    check_mixed(zipped, refused)
    assert refused.filter("raw like 'unreadable archive%'").count() == 1


def test_quoted_fields_and_own_header_order(spark):
    reordered = "DATE1,SERIES, SYMBOL ,NO_OF_TRADES,TTL_TRD_QNTY\n02-Jan-2024,EQ,\"A,B\",2,9\n"
    df = spark.createDataFrame([(text(line("X")),), (reordered,)], "t string")
    got = {r.symbol: r for r in read_daily_text(df, "t")[0].collect()}
    assert got["A,B"].ratio == 4.5 and got["A,B"].close_price is None
    assert got["X"].close_price == 10.5


def test_folder_range_by_file_name(spark, tmp_path):
    folder = tmp_path / "in"
    for n in range(4):
        write_day(folder, n, line("A", n=n))
    (folder / "sec_bhavdata_full_99999999.csv").write_text(text(line("NODATE")))
    (folder / "other.csv").write_text("something else\n")
    # a file of the folder with another header is no problem while its day is not asked for
    write_day(folder, -3, "1,2", header="OLD,LAYOUT")
    good, _ = read_daily(spark, str(folder), day(1), day(2))
    assert {r.date1 for r in good.collect()} == {day(1), day(2)}
    assert read_daily(spark, str(folder), day(50), day(60))[0].count() == 0


def test_different_headers(spark, tmp_path):
    write_day(tmp_path / "a", 0, line("A"))
    short = "SYMBOL,SERIES,DATE1,NO_OF_TRADES,TTL_TRD_QNTY"
    write_day(tmp_path / "b", 1, "B,EQ,02-Jan-2024,2,9", header=short)
    good, _ = read_daily(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert {r.symbol: r.close_price for r in good.collect()} == {"A": 10.5, "B": None}
    write_day(tmp_path / "c", 2, "no,good", header="X,Y")
    # a file without a usable header is refused line by line and stops no other
    good, rejects = read_daily(spark, [str(tmp_path / "a"), str(tmp_path / "c")])
    assert [r.symbol for r in good.collect()] == ["A"]
    assert rejects.filter("reason like 'no usable header%'").count() == 2


def test_swapped_columns_in_one_folder(spark, tmp_path):
    write_day(tmp_path / "in", 0, line("A"))
    swapped = "SERIES,SYMBOL,DATE1,NO_OF_TRADES,TTL_TRD_QNTY,CLOSE_PRICE"
    write_day(tmp_path / "in", 1, "EQ,B,02-Jan-2024,2,9,7.5", header=swapped)
    good, _ = read_daily(spark, str(tmp_path / "in"))
    assert {r.symbol: r.close_price for r in good.collect()} == {"A": 10.5, "B": 7.5}


def test_wide_text(spark):
    """Known columns behind sixty others, one of them quoted with commas and quotes."""
    wide = ",".join(f"x{i}" for i in range(60)) + "," + HEADER
    body = ",".join(f'"a, ""{i}"""' for i in range(60)) + "," + line("A")
    good, rejects = read_daily_text(spark.createDataFrame([(f"{wide}\n{body}\n",)], "t string"), "t")
    assert [(r.symbol, r.close_price) for r in good.collect()] == [("A", 10.5)] and rejects.count() == 0


def test_damaged_archive_is_one_reject(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    with zipfile.ZipFile(folder / "day.zip", "w") as z:
        z.writestr("DAY.CSV", text(*[line(f"S{i}") for i in range(30_000)]))
    data = bytearray((folder / "day.zip").read_bytes())
    at = data.rindex(b"S29999")
    data[at] = ord("T")
    (folder / "day.zip").write_bytes(bytes(data))
    good, rejects = read_daily_zip(spark, str(folder))
    assert good.count() == 0 and rejects.count() == 1


def test_huge_number_is_refused_and_stops_nothing(spark, tmp_path):
    tables = new_tables(spark, tmp_path)
    write_day(tmp_path / "in", 0, line("A"), line("B", close="1e17"))
    load_folder(spark, str(tmp_path / "in"), day(0), day(0), tables)
    assert [r.symbol for r in spark.table(tables.bars).collect()] == ["A"]
    assert spark.table(tables.rejects).filter("reason = 'bad number in close_price'").count() == 1


def test_rejects_of_every_load_are_kept(spark, tmp_path):
    tables = new_tables(spark, tmp_path)
    for n in (0, 1):
        write_day(tmp_path / f"in{n}", n, line("A", n=n), line("BAD", n=n, close="x"))
        load_folder(spark, str(tmp_path / f"in{n}"), day(n), day(n), tables)
    assert spark.table(tables.rejects).count() == 2
    load_folder(spark, str(tmp_path / "in0"), day(0), day(0), tables)
    again = spark.table(tables.rejects).filter("reason = 'day already loaded'")
    assert again.count() == 1 and '"A"' in again.first().raw


@pytest.mark.parametrize("max_files", [1, 8])
def test_stream_merges_the_files_of_a_day(spark, tmp_path, max_files):
    tables = new_tables(spark, tmp_path)
    landing = tmp_path / "in"
    landing.mkdir()
    for i, name in enumerate("ABC"):
        (landing / f"part{i}.csv").write_text(text(line(name), line("SAME", close=str(10 + i)), line(name, n=1)))
    stream_days(spark, str(landing), tables, str(tmp_path / "ck"), max_files=max_files).awaitTermination()
    stored = {(r.symbol, r.date1): r.close_price for r in spark.table(tables.bars).collect()}
    want = {(s, day(n)): 10.5 for s in "ABC" for n in (0, 1)} | {("SAME", day(0)): 10.0}
    assert stored == want
    assert spark.table(tables.indicators).count() == len(want)
    assert spark.table(tables.rejects).filter("reason = 'duplicate key'").count() == 2


def test_load_is_idempotent_and_split_by_series(spark, tmp_path):
    tables = new_tables(spark, tmp_path)
    bootstrap(spark, tables.db, str(tmp_path / "db"))
    write_day(tmp_path / "in", 0, line("A"), line("B", series="BE"))
    write_day(tmp_path / "in", 2, line("C", n=2, series="BE"))
    for _ in range(2):
        missing = load_folder(spark, str(tmp_path / "in"), day(0), day(2), tables)
        assert [r.date1 for r in missing.collect()] == [day(1)]
        assert {r.symbol for r in spark.table(tables.bars).collect()} == {"A"}
        assert {r.symbol for r in spark.table(tables.bars_other).collect()} == {"B", "C"}
        assert {r.date1 for r in spark.table(tables.indicators).collect()} == {day(0)}
        assert sorted(r.date1 for r in spark.table(tables.ledger).collect()) == [day(0), day(2)]
    # a changed file for a loaded day is left alone
    load_days(spark, bars(spark, [bar("LATER", 0)]), tables)
    assert spark.table(tables.bars).filter("symbol = 'LATER'").count() == 0


def test_late_day_refreshes_the_days_that_look_back_on_it(spark, tmp_path):
    tables = new_tables(spark, tmp_path)
    panel = [bar(s, n, ratio=1.0 + n, close=20.0 + n % 7) for s in "AB" for n in range(0, 90, 6)]
    good = bars(spark, panel)
    load_days(spark, good.filter(good.date1 != day(12)), tables)
    load_days(spark, good.filter(good.date1 == day(12)), tables)
    stored = spark.table(tables.indicators)
    assert rows(stored.select(sorted(stored.columns))) == rows(
        build_indicators(good).select(sorted(stored.columns))
    )


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    for n in range(3):
        write_day(landing, n, line("A", n=n, close=str(10 + n)), line("BAD", n=n, close="x"))
    batch = new_tables(spark, tmp_path / "batch")
    load_folder(spark, str(landing), day(0), day(2), batch)

    tables = new_tables(spark, tmp_path / "stream")
    for _ in range(2):  # the second run finds nothing new
        query = stream_days(spark, str(landing), tables, str(tmp_path / "cp"), max_files=2)
        query.awaitTermination()
        assert rows(spark.table(tables.bars)) == rows(spark.table(batch.bars))
        assert rows(spark.table(tables.indicators)) == rows(spark.table(batch.indicators))
        assert spark.table(tables.ledger).count() == 3
        assert spark.table(tables.rejects).count() == 3


def test_inferred_append(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    table = f"{new_tables(spark, tmp_path).db}.inferred"
    for _ in range(2):
        append_inferred(spark, str(tmp_path / "x.csv"), table)
    assert [f.dataType.simpleString() for f in spark.table(table).schema.fields] == ["int", "string"]
    assert spark.table(table).count() == 4

import datetime as dt

from pyspark.sql import functions as F

from eodscan.functions import (
    deep_link,
    file_date,
    file_name_for,
    is_series,
    number_or_null,
    parse_trade_date,
    two_decimals,
    unit_ratio,
    whole_number_or_null,
)


def values(spark, schema, data, expr):
    return [r[0] for r in spark.createDataFrame([(d,) for d in data], schema).select(expr).collect()]


def test_dates(spark):
    data = [" 1-Jan-2024\t", "05-JAN-2024", "05-jan-2024", "2024-01-05", "31-Feb-2024", "", None]
    fifth = dt.date(2024, 1, 5)
    got = values(spark, "c string", data, parse_trade_date(F.col("c")))
    assert got == [dt.date(2024, 1, 1), fifth, fifth, None, None, None, None]
    names = [file_name_for(fifth), "x_" + file_name_for(fifth), file_name_for(fifth) + "x"]
    assert values(spark, "c string", names, file_date(F.col("c"))) == [fifth, None, None]


def test_numbers(spark):
    data = [" 12.5\t", "-3", "NaN", "Infinity", "abc", "", None, "12.0"]
    got = values(spark, "c string", data, number_or_null(F.col("c")))
    assert got == [12.5, -3.0, None, None, None, None, None, 12.0]
    whole = values(spark, "c string", data, whole_number_or_null(F.col("c")))
    assert whole == [None, -3, None, None, None, None, None, 12]
    ratio = values(spark, "c int", [4, 0, None], unit_ratio(F.lit(10.0), F.col("c")))
    assert ratio == [2.5, None, None]


def test_texts(spark):
    got = values(spark, "c string", ["EQ", " EQ ", "\tEQ", "BE", None], is_series(F.col("c")))
    assert got == [True, True, True, False, False]
    assert values(spark, "c double", [1.5, None], two_decimals(F.col("c"))) == ["1.50", None]
    link = deep_link("http://h", F.col("c"), F.lit(dt.date(2024, 1, 5)))
    assert values(spark, "c string", ["A"], link) == ["http://h/?symbol=A&date=2024-01-05"]

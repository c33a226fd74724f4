"""Date expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from eodscan.functions.text import strip

# fixed values: the daily file is named <prefix>DDMMYYYY<suffix>
FILE_PREFIX = "sec_bhavdata_full_"
FILE_SUFFIX = ".csv"


def parse_trade_date(col: Column) -> Column:
    """`05-Jan-2024`, blanks around it allowed; anything else gives null."""
    return F.try_to_date(strip(col), "d-MMM-yyyy")


def file_date(name: Column) -> Column:
    """Day a file name stands for; null when the name is not a daily file."""
    digits = F.regexp_extract(name, rf"^{FILE_PREFIX}(\d{{8}})\{FILE_SUFFIX}$", 1)
    return F.try_to_date(F.nullif(digits, F.lit("")), "ddMMyyyy")


def file_name_for(day: dt.date) -> str:
    return f"{FILE_PREFIX}{day:%d%m%Y}{FILE_SUFFIX}"

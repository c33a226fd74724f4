from eodscan.functions.dates import file_date, file_name_for, parse_trade_date
from eodscan.functions.numbers import (
    at_scale,
    number_or_null,
    percent_change,
    two_decimals,
    unit_ratio,
    whole_number_or_null,
)
from eodscan.functions.text import alpha_first, deep_link, is_series, strip

__all__ = [
    "alpha_first",
    "at_scale",
    "deep_link",
    "file_date",
    "file_name_for",
    "is_series",
    "number_or_null",
    "parse_trade_date",
    "percent_change",
    "strip",
    "two_decimals",
    "unit_ratio",
    "whole_number_or_null",
]

import os

import pytest

import __spark_entry__ as entry
from eodscan.checks.compare import compare

SF = "/root/testdata/sf0.001"
QUICK = [
    "unit_ratio",
    "moving_avg_close",
    "moving_avg_ratio",
    "prev_day_ratio",
    "pivot_latest",
    "dashboard",
    "alpha_first_sort",
    "coverage_gaps",
    "csv_rejects",
    "duplicate_rows",
]


def test_every_query_has_sql():
    # text operators have SQL only where SQL can state them
    market = set(entry.registered.queries())
    assert market == set(entry.oracles.oracle_sql())
    assert market <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    ok, text = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text

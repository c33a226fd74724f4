"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs over the whole tables into a sink that keeps nothing; each is timed once after one
untimed warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from eodscan.checks.compare import session
from eodscan.checks.queries import queries

HEADLINE = [
    "indicator_build",
    "moving_avg_all_dates",
    "dashboard",
    "dashboard_one_date",
    "hot_cake",
    "symbol_snapshot",
    "ladder",
    "signal_history",
    "top2_flags",
    "prev_day_ratio",
    "fno_flag",
    "symbol_list",
    "csv_round_trip",
    "duplicate_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    registered, seconds = queries(), {}
    registered["unit_ratio"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        started = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

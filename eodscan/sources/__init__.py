from eodscan.sources.daily import (
    archive_lines,
    one_row_per_key,
    read_daily,
    read_daily_text,
    read_daily_zip,
    split_lines,
    split_typed,
)
from eodscan.sources.scratch import scratch_dir
from eodscan.sources.tables import (
    Tables,
    append_inferred,
    bootstrap,
    load_days,
    load_folder,
    refresh_after_late_load,
)

__all__ = [
    "Tables",
    "append_inferred",
    "archive_lines",
    "bootstrap",
    "load_days",
    "load_folder",
    "one_row_per_key",
    "read_daily",
    "read_daily_text",
    "read_daily_zip",
    "refresh_after_late_load",
    "scratch_dir",
    "split_lines",
    "split_typed",
]

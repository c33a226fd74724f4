from eodscan.operators.frames import (
    equity,
    exact_mean,
    lookback,
    moving_averages,
    prev_day_value,
    recency_rank,
)
from eodscan.operators.membership import (
    available,
    coverage_gaps,
    date_spine,
    fno_flag,
    new_dates_only,
    upload_window,
)
from eodscan.operators.shapes import ladder, latest_pivot, reindex, relabel, serial_number
from eodscan.operators.signals import (
    bands,
    display_flags,
    spike_signals,
    tier_signals,
    top2_flags,
)

__all__ = [
    "available",
    "bands",
    "coverage_gaps",
    "date_spine",
    "display_flags",
    "equity",
    "exact_mean",
    "fno_flag",
    "ladder",
    "latest_pivot",
    "lookback",
    "moving_averages",
    "new_dates_only",
    "prev_day_value",
    "recency_rank",
    "reindex",
    "relabel",
    "serial_number",
    "spike_signals",
    "tier_signals",
    "top2_flags",
    "upload_window",
]

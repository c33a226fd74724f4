from eodscan.plans.indicators import build_indicators, with_price_change
from eodscan.plans.screens import (
    DASHBOARD_LABELS,
    HOT_CAKE_LABELS,
    alpha_first_sort,
    dashboard,
    hot_cake,
)
from eodscan.plans.symbol import (
    HISTORY_LABELS,
    LADDER_LABELS,
    signal_history,
    snapshot,
    symbol_ladder,
    symbol_list,
)

__all__ = [
    "DASHBOARD_LABELS",
    "HISTORY_LABELS",
    "HOT_CAKE_LABELS",
    "LADDER_LABELS",
    "alpha_first_sort",
    "build_indicators",
    "dashboard",
    "hot_cake",
    "signal_history",
    "snapshot",
    "symbol_ladder",
    "symbol_list",
    "with_price_change",
]

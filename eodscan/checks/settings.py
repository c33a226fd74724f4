"""Parameters the registered queries and their SQL share."""

LINK_BASE = "http://localhost/symbol"
SPINE_START, SPINE_END = "1994-12-01", "2001-12-31"
LAST_DAY = "2001-06-29"
LADDER_SYMBOLS = [f"NATION_{i}" for i in range(0, 25, 2)]
RANGE_START, RANGE_END = "1997-03-02", "1999-10-01"

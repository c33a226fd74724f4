"""End-of-day market scanner on Spark."""

from eodscan.operators import *  # noqa: F401,F403
from eodscan.plans import *  # noqa: F401,F403
from eodscan.sources import *  # noqa: F401,F403
from eodscan.streaming import stream_days  # noqa: F401

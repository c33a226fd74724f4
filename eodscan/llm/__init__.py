"""Operators for preparing training text; nothing else in the library imports this subpackage.

Task functions are pickled by value, so executors need numpy, pyarrow and pandas, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-first search, faceted analytics and corpus processing.

Worker code is pickled by value, so executors do not need this package on
their own path.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

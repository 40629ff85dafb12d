"""Profiling, cleaning, vectorising and clustering of large text corpora with PySpark."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel with their plan, so executors
# need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

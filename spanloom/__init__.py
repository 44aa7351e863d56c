"""Span-annotated text corpora as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel by value, so executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

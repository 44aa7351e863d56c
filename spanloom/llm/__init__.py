"""Operators of a training-data pipeline; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

from spanloom.llm import arrays, stage

# like the library's other modules, these travel to the Python workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native engine for inspecting large collections of source files and documents.

Everything is a plain function from DataFrames to DataFrames.  Functions that run inside Python
workers are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

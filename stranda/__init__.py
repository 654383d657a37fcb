"""stranda: analytics over genetic-variant tables, interval tables and their raw records, on Spark DataFrames."""
import sys

from pyspark import cloudpickle

# Functions that run on Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

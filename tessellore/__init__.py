"""Tessellore: a PySpark-native engine for documentation retrieval and corpus processing."""

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to Python workers travel by value, so executors need no copy of this package.
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"

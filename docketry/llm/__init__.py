"""Operators for training-data pipelines; nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training data. Their task functions travel by value, so that workers need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

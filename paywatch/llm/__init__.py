"""Operators for training-data pipelines. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Python workers get the functions by value, so a source tree on the driver is enough.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

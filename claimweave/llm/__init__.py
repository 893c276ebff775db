"""Operators of a large-scale training-data pipeline. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: a cluster needs no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

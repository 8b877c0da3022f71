"""Spark-native analytics for medication-safety data: composable DataFrame-to-DataFrame functions."""

import sys

from pyspark import cloudpickle

# Task functions travel by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

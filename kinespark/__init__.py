"""Spark-native analytics for paired (left/right) motion-sensor recordings."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the few functions that run in Python workers travel with the task, so that the executors need no
# copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

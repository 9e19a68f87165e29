"""A Spark-native engine for streams of machine-vision detections."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native analytics over typed property graphs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

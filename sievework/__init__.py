"""Spark-native dataset curation and sequence annotation."""

import sys

from pyspark import cloudpickle

# Functions that run inside executors travel by value, so a cluster needs no
# copy of this package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

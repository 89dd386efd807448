"""Trajectory mining on Spark DataFrames: stay points, density regions, recommendations."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: task functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

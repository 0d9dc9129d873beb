"""Scoreline: a PySpark engine for stream metadata and scoreboard observations."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

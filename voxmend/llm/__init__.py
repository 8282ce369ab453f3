"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this subpackage's code along, so a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

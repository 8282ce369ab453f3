"""A PySpark engine that prepares, checks and scores text corrections of speech recognition output."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code along, so a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

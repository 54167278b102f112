"""Entity resolution and corpus preparation as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their task: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""quadrat: analysis of designed experiments and ecological communities on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so the package need not be installed on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Document-corpus analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions travel to executors as they are, so these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

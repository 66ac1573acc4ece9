"""Care-conversation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so a cluster does
# not need the package installed on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

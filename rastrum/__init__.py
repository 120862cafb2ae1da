"""Dense arrays and rasters as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

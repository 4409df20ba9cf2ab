"""framesafe: privacy work on large collections of video metadata, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions travel to the executors by value, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

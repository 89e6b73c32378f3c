"""Climate-exposure analytics on Spark DataFrames: long tables with integer cell keys."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value: a cluster needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

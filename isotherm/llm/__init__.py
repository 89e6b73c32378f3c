"""Operators of a training-data pipeline over text corpora.

Nothing else in the package imports this subpackage.  Functions that run on
executors are pickled by value, so a cluster needs no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

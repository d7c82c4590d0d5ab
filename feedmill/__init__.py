"""Feed and document analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions that run in tasks are sent along with what they use, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

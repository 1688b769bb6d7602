"""quire: document analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

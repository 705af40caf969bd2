"""Analytics over source-code corpora and training data, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

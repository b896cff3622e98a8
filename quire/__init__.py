"""Document analytics on Spark DataFrames: profiling, extraction, chunking, indexing, facts, search and claims."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with the plan, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

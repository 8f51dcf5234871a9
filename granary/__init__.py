"""A PySpark engine for document retrieval, ranking, usage analytics and corpus building."""

import sys

from pyspark import cloudpickle

# Tasks get the package's functions by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

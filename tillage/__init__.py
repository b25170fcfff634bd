"""A Spark-native engine for knowledge graphs built from documents.

Functions that run inside tasks are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

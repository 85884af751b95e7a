"""Operators of a training-data pipeline over documents, embeddings and
conversations. Nothing outside this subpackage imports it.

Functions that run in Python workers are shipped by value, so executors do not
need this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for preparing text corpora at scale: scoring, deduplication, packing, search, mixing."""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators of a training-data pipeline: extraction, filters, near duplicates, mixing, coding.

Functions that run inside Spark's Python workers travel by value, so executors
need the public libraries only, not this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

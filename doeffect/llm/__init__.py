"""Operators of a training-data pipeline.

Functions that run in Python workers are pickled by value, so executors need
numpy and pyarrow but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

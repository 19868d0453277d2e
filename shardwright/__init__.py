"""Shardwright: package forensics and training-data operators on PySpark.

Functions that run inside Python tasks are pickled by value, so executors need
no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""stridemark: photo-reading match analytics and training-data operators, written for Spark.

Functions that run in Python workers are pickled by value, so that a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

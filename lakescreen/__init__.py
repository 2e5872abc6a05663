"""lakescreen: document screening and corpus preparation on Spark.

The functions that run inside Python workers are pickled by value, so a cluster needs no copy of the package on its
executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

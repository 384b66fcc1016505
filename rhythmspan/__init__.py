"""Batch jobs over large archives of ambulatory heart recordings, on Spark.

Functions of this package travel to the executors inside the jobs, so that a cluster needs no
copy of the package of its own.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

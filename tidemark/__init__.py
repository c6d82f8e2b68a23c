"""Time-aware transaction analytics and evaluation as PySpark DataFrame operators.

Functions that run in Python workers are sent with the job, so that executors
need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

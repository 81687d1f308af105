"""Security-log detection, its evaluation, and training-data operators as Spark jobs.

Functions that run inside tasks are shipped by value, so executors need
neither this package installed nor a shared ``PYTHONPATH``.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

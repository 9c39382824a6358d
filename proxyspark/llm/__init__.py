"""Operators of a training-data pipeline; nothing else in the library imports them.

Functions of this package travel to the Python workers by value, so a worker
needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

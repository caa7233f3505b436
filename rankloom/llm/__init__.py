"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions of this subpackage reach executors by value, so that executors need no copy of the
repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

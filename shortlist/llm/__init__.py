"""Operators for preparing training text at scale; nothing else in the library imports this subpackage.

Task functions are pickled by value, so executors need not have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

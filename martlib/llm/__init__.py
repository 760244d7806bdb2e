"""Operators for large training corpora.

Tasks get this subpackage's functions by value, so executors need no copy of the code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

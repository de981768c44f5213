"""Operators for preparing training text, and their queries.

Nothing outside this subpackage imports it. The functions that run in Python
workers are shipped by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

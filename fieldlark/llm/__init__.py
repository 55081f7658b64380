"""Operators of a training-data pipeline: ten operators, each in a module of its own.

Nothing else in the library imports this package. Python code that runs inside
tasks is shipped by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators of a training-data pipeline over web documents.

Python workers get the functions of this package by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

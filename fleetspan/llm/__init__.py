"""Operators of a training-data pipeline over documents, pages and conversations."""

import sys

from pyspark import cloudpickle

# Python workers get these functions by value: they need not be able to import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

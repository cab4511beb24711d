"""Operators for preparing training text: deduplication, labelling, mixing, tokenizing, vector search.

Nothing else in the library imports this folder. Functions that run in Python
on the executors travel by value, so workers need not find this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

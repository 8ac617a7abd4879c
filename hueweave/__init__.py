"""Hueweave: a PySpark-native engine for coloured k-mer sets.

Functions that run on executors are pickled by value, so executors need no copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

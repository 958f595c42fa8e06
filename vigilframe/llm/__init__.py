"""Operators for preparing training corpora; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions go to the executors with their code: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

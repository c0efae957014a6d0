"""Training-data operators: cleaning, deduplication, search, mixing, packing and archives."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Product analytics on Spark: events, cohorts, revenue, alerts, data quality and structured text."""

import sys

from pyspark import cloudpickle

# Executors get Python functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

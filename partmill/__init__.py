"""Set-oriented product-catalog enrichment on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

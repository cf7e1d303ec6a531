"""Operators that prepare training text: sharding, deduplication, filters, extraction, archives and packing."""

import sys

from pyspark import cloudpickle

# Python tasks carry these functions with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: scoring, sharding, mixing, tokenising, filtering and near-duplicate search.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""

import sys

from pyspark import cloudpickle

# What runs in Python workers travels with its task, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: fingerprints, dedup, search, filters, packing, mixing.

Functions of this package travel to the executors with the tasks that use
them, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

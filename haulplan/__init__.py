"""Freight load consolidation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The small numpy helpers travel to the executors with the tasks, so a cluster
# needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

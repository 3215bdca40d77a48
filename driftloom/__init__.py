"""driftloom: concept-drift analytics over labelled text streams, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Step functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Tables out of documents, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Parsers travel to the executors inside the plan, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

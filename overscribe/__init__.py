"""A Spark-native engine for document supersession: is a document an update of an earlier one, new, or redundant?"""

import sys

from pyspark import cloudpickle

# Tasks carry the engine's own functions with them, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

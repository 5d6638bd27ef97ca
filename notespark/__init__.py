"""notespark: knowledge-base analytics over note collections, as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers are sent to them by value, so that
# executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

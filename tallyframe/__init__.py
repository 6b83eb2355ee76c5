"""Audit labelled datasets with many model verdicts, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Send the package's own functions to the Python workers by value, so that executors need
# not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

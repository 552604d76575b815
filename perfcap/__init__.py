"""perfcap: performance-capture analytics on Spark DataFrames.

Every operator is a function from DataFrames to DataFrames (or from Columns to a
Column).  Nothing here runs an action except the sinks and the stream starters.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of this package: its few Python functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark analyses of posts, baskets, time series and hourly measurements.

Every operator takes DataFrames and column names and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the Python workers as they are, so that an executor needs
# neither the package nor the folder it lies in.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

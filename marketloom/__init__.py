"""PySpark library of operators and jobs for market, macro, news and forum data."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so that the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

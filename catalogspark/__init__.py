"""Spark-native analytics for shared-file catalogs.

Public functions take and return DataFrames. Nothing here holds a global
session, and no operator collects data to the driver.
"""

import sys

from pyspark import cloudpickle

# Python tasks carry their code with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

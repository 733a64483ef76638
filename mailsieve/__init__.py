"""Screening of labelled message corpora on Spark.

Every public function takes DataFrames or Columns and gives DataFrames or
Columns back; nothing here keeps session state.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

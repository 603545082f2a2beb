"""marketloom: market analytics as Spark DataFrame transforms.

Every public function takes and returns DataFrames (or Columns); nothing is
computed until the caller runs an action.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run in tasks travel with the job, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Grid-based Bayesian inference and catalogue work as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the job, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

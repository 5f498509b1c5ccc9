"""Operators for large training-data pipelines. Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Executors receive the functions themselves; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

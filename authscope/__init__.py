"""Anomaly detection over authentication logs and network flows, on Spark."""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with the task, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Curating text corpora and scoring model responses, as DataFrame operations."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

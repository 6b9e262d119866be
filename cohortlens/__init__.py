"""Cohort and group performance analytics as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

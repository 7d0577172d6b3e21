"""Candidate records on Spark: documents in, validated and ranked records out."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

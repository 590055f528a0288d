"""Spark-native scanning, cleaning and verification of private traces in file corpora."""

import sys

from pyspark import cloudpickle

# Functions and classes travel to the executors with the job, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data pipelines. Their task functions travel with the job, so executors need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

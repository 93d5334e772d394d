"""Retail-inventory analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from stocklens.sources.tables import Tables

# Functions that run in Python workers travel with the job, so that the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Tables"]

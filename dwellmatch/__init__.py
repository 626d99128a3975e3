"""Listing-match analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions used in tasks travel with their code, so executors need no copy of
# this package and no particular working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

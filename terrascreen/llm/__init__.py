"""Operators for building text corpora: filters, fingerprints, duplicates, search, tokens and packing."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the executors with the job, so clusters need not install the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

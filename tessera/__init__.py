"""Tessera: a PySpark-native analytics and retrieval engine for large text corpora."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code: a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

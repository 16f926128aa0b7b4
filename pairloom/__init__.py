"""Retrieval training data, distillation and evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Tasks carry the few Python helpers themselves: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

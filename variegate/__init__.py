"""Semantic-diversity analytics over generated ideas, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

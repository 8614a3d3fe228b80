"""Text grammars, trees and text pipelines as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors get our functions by value, so that a job needs no installation on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

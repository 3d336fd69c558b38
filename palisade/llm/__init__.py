"""Operators for building training data from large document tables.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the job: no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

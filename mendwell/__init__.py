"""mendwell: batch analytics over device complaints, articles and settings links, as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

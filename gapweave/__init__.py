"""Missing-data analytics as Spark jobs: plant gaps, fill them, measure the effect."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

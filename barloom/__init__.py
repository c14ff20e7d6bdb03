"""Bar, signal and portfolio analytics as keyed PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in workers travel with the job, so that the
# package needs no installation on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

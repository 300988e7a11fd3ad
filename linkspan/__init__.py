"""linkspan - person-record linkage, review and reporting as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors get the few Python helpers with the job itself; nothing has to be
# installed or copied to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

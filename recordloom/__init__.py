"""Lazy DataFrame operators for turning messy yearly record sheets into statistics."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

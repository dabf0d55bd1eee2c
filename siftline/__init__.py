"""siftline: document triage at scale, written as plain PySpark jobs.

Rules are data, documents are DataFrames, and every step is a lazy
``DataFrame -> DataFrame`` function, so Catalyst plans the whole run.
"""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with their tasks; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Case-file, evidence and identity-screening analytics on Spark DataFrames."""
import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with the job, wherever it was started from
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Market bars, regimes, signals, risk and event history as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

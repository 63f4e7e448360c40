"""Point-in-time time-series analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

from .session import build_session

# The few Python functions that run in tasks travel with their code, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]

"""barsmith: market-data operators on Spark DataFrames and Structured Streaming.

Every operator is a plain function ``f(df, ...) -> DataFrame`` that builds a lazy
plan; nothing in the library triggers an action.  See README.md for the map of
operators to modules.
"""

import sys as _sys

from barsmith.session import get_spark, checkpoint_dir

# Python callbacks that run on executors (grouped pandas functions, state
# functions) are shipped by value, so executors need no installed copy of
# this package.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["get_spark", "checkpoint_dir"]

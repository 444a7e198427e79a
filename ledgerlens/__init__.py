"""ledgerlens: sales line-item analytics expressed as Spark DataFrame plans.

Every public operator takes DataFrames (plus column names and parameters)
and returns a lazy DataFrame; filtering, grouping, joining and model
statistics run on the executors, and only small summaries (quantile
brackets, model coefficients) are ever materialised.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# Python workers need no installed copy of this package: functions and
# classes defined here (the grouped OLS solve) are pickled by value.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

from ledgerlens.session import checkpoint_dir, get_spark  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir"]

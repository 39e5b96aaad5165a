"""tabeval: tabular model evaluation and explanation consistency on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is drawn,
and nothing whole passes through the driver.  Sub-packages:

- ``sources``   read / write tables, models and feature lists
- ``functions`` Column-level helpers (sign with dead zone, threshold counts, ...)
- ``operators`` profile, clean, split, balance, scale, select, classify,
                evaluate, explain, consistency
- ``plans``     end-to-end plans and the testdata fixtures used by the oracles
- ``streaming`` the evaluation aggregates over a Structured Streaming source
"""

from tabeval.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the job: executors need not have the
# package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

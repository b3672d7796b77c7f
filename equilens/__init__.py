"""equilens: group-bias audits of binary decisions, as Spark DataFrame jobs."""

import sys as _sys

__version__ = "0.1.0"

# Functions used inside Arrow UDFs (kNN blocks, LIME fits, TreeSHAP) are shipped
# to the Python workers by value, so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: workers must import the package
    pass

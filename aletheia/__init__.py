"""aletheia — Spark-native probe analytics over labelled activation data.

DataFrame in, DataFrame out: probe-set preparation, grouped sampling and
splits, many-probe fitting in one MLlib pass, grouped ROC AUC and the
evaluation modes built on them.
"""

import sys as _sys

try:  # ship this package's functions by value to Python workers (mapInPandas)
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"

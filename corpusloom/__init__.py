"""corpusloom: Spark-first preparation, retrieval, dedup and evaluation of document corpora."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Workers receive our functions by value, so an executor needs no copy of this package on its path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"

"""weblode: a PySpark engine for crawled pages, discovered files and the document store built from them."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the few Python helpers used inside tasks by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""A PySpark engine for historical knowledge data, with operators for training corpora in `annalum.llm`."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

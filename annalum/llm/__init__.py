"""Operators for preparing language-model training corpora.

One module per operator, each with a general interface and a thin query;
`registry` lists the queries and, where SQL can express them, their SQL.
Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

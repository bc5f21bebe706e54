"""Operators for preparing language-model training data, and their queries.

Nothing else in the library imports this package. Functions sent to the
executors are pickled by value, so a cluster's Python workers need only NumPy,
pyarrow and the tokenizer libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

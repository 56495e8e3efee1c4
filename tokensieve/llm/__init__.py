"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  Every operator takes
DataFrames, selects the columns it names in its docstring and ignores any
others, so extra columns with clashing names are harmless.
"""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

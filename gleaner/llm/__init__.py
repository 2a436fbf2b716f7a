"""Operators for building text corpora for language-model training.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# The functions that run inside tasks are shipped whole, so that executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

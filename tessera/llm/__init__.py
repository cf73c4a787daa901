"""Training-data operators. Nothing outside this subpackage imports it.

Functions sent to executors are pickled by value, so executors need no copy of the package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

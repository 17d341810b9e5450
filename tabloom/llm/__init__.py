"""Operators for large-scale training-data pipelines (near-dedup, scoring, packing, ...).

Nothing else in the library imports this subpackage.  The functions that run inside tasks are
pickled by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

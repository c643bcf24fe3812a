"""Operators for preparing training data; each module holds one operator.

The functions that run inside Arrow tasks are shipped with their closures, so that
executors need the installed libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

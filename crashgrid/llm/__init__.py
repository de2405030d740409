"""Operators for preparing training corpora: filters, de-duplication, mixing and packing.

Functions of this package that run inside tasks travel with the task, so that executors need no
copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

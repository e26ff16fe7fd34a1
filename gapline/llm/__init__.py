"""Operators of a training-data pipeline.

Nothing else in the package imports this one. Its functions run inside tasks, so
they are shipped by value: executors need only numpy and pyarrow, not gapline.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

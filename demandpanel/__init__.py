"""Visitor-demand analytics on Spark DataFrames.

Every operator takes and returns a ``DataFrame``; every panel carries a
``node`` key so that one job serves all sites at once.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow functions travel with their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

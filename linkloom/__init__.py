"""linkloom: crawl-data jobs (parts, links, frontier, exchange) as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""packloom: packet-capture analytics on PySpark.

Functions that run on executors are shipped by value, so executors need numpy, pyarrow and
pandas but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

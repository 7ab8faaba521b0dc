"""Label analytics on Spark: DataFrame-in, DataFrame-out operators over printed ingredient lists."""
import sys

from pyspark import cloudpickle

# UDF kernels travel to the executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

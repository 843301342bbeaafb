"""Media-library analytics as Spark DataFrame operators."""

from pyspark import cloudpickle

from shutterlake.operators import kernels

# Task code travels with the job, so executors need only numpy, pandas and Arrow.
cloudpickle.register_pickle_by_value(kernels)

__version__ = "0.1.0"

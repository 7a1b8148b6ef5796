"""Motion-sensor analytics as Spark DataFrame operators.

Every public function takes DataFrames and returns DataFrames; functions that run a job say so in
their docstring.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

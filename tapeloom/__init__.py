"""tapeloom: DataFrame operators that join daily price series with news articles.

Every operator is a plain ``f(df, ..., keys=("symbol",)) -> DataFrame``: it builds a lazy plan and leaves the
physical strategy to Catalyst and AQE.
"""

import sys

from pyspark import cloudpickle

# Ship the package's functions with the tasks, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

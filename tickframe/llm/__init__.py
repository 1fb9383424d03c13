"""Training-data operators (subpackage ``llm``).

Nothing else in the library imports this package.  Its functions run inside
Spark's Python workers, which need not have the repository on their path, so
the package is pickled by value into each job.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

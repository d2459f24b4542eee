"""Training-data operators: one module per operator, queries in ``queries``.

Nothing else in the library imports this package.  Functions shipped to
executors are pickled by value, so a cluster does not need the package
installed on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

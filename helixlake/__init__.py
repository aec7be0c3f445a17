"""helixlake: PySpark operators for spectra, hypervectors, search hits, sequence graphs and run metrics."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel with their code, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

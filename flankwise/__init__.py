"""Evidence ranking for short degenerate DNA motifs, written as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Helper functions travel with the tasks, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

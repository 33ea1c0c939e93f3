"""Long-term agent memory as Spark tables: build, query, consolidate, evaluate."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

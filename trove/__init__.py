"""trove: retrieval, table cards and document clustering as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run inside tasks travel with the plan, so executors need no
# copy of this package on their path.
register_pickle_by_value(sys.modules[__name__])

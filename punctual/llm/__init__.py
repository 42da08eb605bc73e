"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Nothing else in the library imports this package. Its functions travel to the executors by
value, so a cluster needs no copy of the library beside the job.
"""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

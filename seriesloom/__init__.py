"""seriesloom: leakage-aware series features, evaluation and run analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from .spec import SeriesSpec

# Arrow functions travel with the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SeriesSpec"]

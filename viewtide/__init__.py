"""viewtide: content-popularity analytics as Spark DataFrame and streaming jobs."""

import sys

from pyspark import cloudpickle

from viewtide.config import CountingConfig, ShapeConfig, TrendingConfig

# Task-side code travels with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CountingConfig", "ShapeConfig", "TrendingConfig"]

"""Operators of a large-scale training-data pipeline, and their registered queries."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

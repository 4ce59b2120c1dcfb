"""Operators for preparing training text at scale; nothing else in the library imports them."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

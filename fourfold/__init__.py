"""Fourfold: four-valued (two-bit) state analytics on Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Workers need not have this package installed: what a task uses travels with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

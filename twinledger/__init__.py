"""Reconcile two tables at scale: where do source A and source B agree, and where not?"""

import sys

from pyspark import cloudpickle

from .spec import AnyOf, Pair

# Functions of this package that run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["AnyOf", "Pair"]

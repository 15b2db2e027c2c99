"""Spark-native engine for medical-imaging dataset preparation and analytics.

Relational work is plain DataFrame/SQL; array work runs as Arrow batches of
NumPy kernels.  Functions that run on executors are shipped with the query
(pickled by value), so executors need no copy of this package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

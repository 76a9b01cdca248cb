"""Spark-native analytics over software-structure data: metrics, rules, graphs, snapshots and roll-ups as DataFrames."""

from pyspark import cloudpickle as _cloudpickle

import codestrata as _self

# Functions that run on executors are shipped whole, so a cluster needs no copy of this package on its path.
_cloudpickle.register_pickle_by_value(_self)

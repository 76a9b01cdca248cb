"""Rounding as the metric definitions ask for it: half to even, at a number of decimals."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, decimals: int = 0) -> Column:
    scale = float(10**decimals)
    return F.rint(x * scale) / scale


def mean(total: Column, count: Column) -> Column:
    """Mean of integers: their exact sum over their count; null for none."""
    return total.cast("double") / count

"""Sums of doubles that don't depend on the order of their rows.

Added in another order, doubles differ in their last digits, and a shuffle brings rows in any order. A sum that a plan works out twice,
to be compared with itself or joined on, must come out the same both times. Here every value is cut into three whole numbers
(units, and two parts of 36 bits after the point), whose sums are exact; they meet in one double at the end. What lies below
2 ** -72, nothing for most values, is added as a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.functions.nulls import as_col, div

_STEP = float(1 << 36)
# larger values, infinities and NaN are added as doubles: 9e9 values of this size fit into a whole number
_NEAR = 1e9


def steady_sum(c: Column | str) -> Column:
    """The sum of the values present, the same for every order of rows; NULL without one."""
    x = as_col(c).cast("double")
    near = F.abs(x) < _NEAR
    v = F.when(near, x)
    units = v.cast("long")
    rest = (v - units) * _STEP
    first = rest.cast("long")
    low = (rest - first) * _STEP
    second = low.cast("long")
    exact = F.sum(units) + (F.sum(first) + (F.sum(second) + F.sum(low - second)) / _STEP) / _STEP
    far = F.sum(F.when(~near, x))
    return F.when(far.isNull(), exact).when(exact.isNull(), far).otherwise(exact + far)


def steady_mean(c: Column | str) -> Column:
    """The mean of the values present, the same for every order of rows."""
    return div(steady_sum(c), F.count(as_col(c)))

"""Missing-value contract: NaN, infinities and unreadable text all become NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The double value, or NULL when it is NaN or infinite."""
    v = as_col(c).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def number(c: Column | str, decimal_comma: bool = False) -> Column:
    """Text to a finite double; unreadable text becomes NULL."""
    text = F.trim(as_col(c))
    if decimal_comma:
        text = F.replace(text, F.lit(","), F.lit("."))
    return finite(text.try_cast("double"))


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))

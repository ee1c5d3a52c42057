"""Calendar bucket expressions.

Labels: day buckets carry their first day; week buckets their closing Sunday; month
and year buckets their last day. A bucket of n weeks, months or years closes on the
first single bucket of the series and on every n-th one after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.nulls import as_col


def _sunday(d: Column) -> Column:
    return F.date_add(F.date_trunc("week", d).cast("date"), 6)


def normalise_freq(code: str) -> str:
    code = str(code).upper()
    return code if code in ("D", "W", "M", "A") else "D"


def bucket(date: Column | str, freq: str = "D", n: int = 1, origin: Column | None = None) -> Column:
    """Label of the n-fold calendar bucket holding ``date``; n > 1 needs ``origin``."""
    d, freq, n = as_col(date).cast("date"), normalise_freq(freq), max(int(n), 1)
    if n > 1 and origin is None:
        raise ValueError("a bucket of several units needs an origin date")
    if freq == "D":
        if n == 1:
            return d
        return F.date_add(origin, (F.floor(F.datediff(d, origin) / n) * n).cast("int"))
    if freq == "W":
        if n == 1:
            return _sunday(d)
        steps = F.ceil(F.datediff(_sunday(d), _sunday(origin)) / (7 * n))
        return F.date_add(_sunday(origin), (steps * 7 * n).cast("int"))
    if freq == "M":
        if n == 1:
            return F.last_day(d)
        apart = (F.year(d) - F.year(origin)) * 12 + F.month(d) - F.month(origin)
        return F.last_day(F.add_months(F.trunc(origin, "month"), (F.ceil(apart / n) * n).cast("int")))
    if n == 1:
        return F.make_date(F.year(d), F.lit(12), F.lit(31))
    y0 = F.year(origin)
    return F.make_date((y0 + F.ceil((F.year(d) - y0) / n) * n).cast("int"), F.lit(12), F.lit(31))


def bucket_origin(df: DataFrame, date: str = "date") -> Column:
    """First day of the frame as a scalar subquery, shared by every run of an ensemble."""
    return df.agg(F.min(F.col(date).cast("date"))).scalar()


def in_months(date: Column | str, months: Sequence[int] | None) -> Column:
    if not months:
        return F.lit(True)
    return F.month(as_col(date)).isin([int(m) for m in months])


def not_feb29(date: Column | str) -> Column:
    d = as_col(date)
    return ~((F.month(d) == 2) & (F.dayofmonth(d) == 29))

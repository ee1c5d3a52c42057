"""All registered queries."""

from __future__ import annotations

from functools import lru_cache

from freshet.plans import basin, fit, records, series
from freshet.plans.registry import Registry


@lru_cache(maxsize=1)
def catalog() -> Registry:
    r = Registry()
    for module in (series, fit, basin, records):
        module.register(r)
    return r

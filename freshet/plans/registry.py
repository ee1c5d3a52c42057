"""Registered queries: name to (callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.plans.views import DIGITS, rounded, rsql

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.body: dict[str, str] = {}

    def add(self, name: str, fn: Query, sql: str | None = None, ctes: str = "", doubles: str = "", others: str = "",
            digits: int = DIGITS) -> None:
        """Register a query; its SQL body is wrapped so both sides carry the same rounding."""
        if name in self.queries:
            raise ValueError(f"query {name!r} registered twice")
        wanted = others.split() + doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return rounded(out.select(*wanted) if wanted else out, digits)

        self.queries[name] = run
        if sql is not None:
            self.body[name] = sql
            self.sql[name] = rsql(sql, ctes, doubles, others, digits)

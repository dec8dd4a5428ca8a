"""A group of queries: each a function of (spark, sf_dir), most with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.sources.tables import TEXTS, load, with_sql

Query = Callable[[SparkSession, str], DataFrame]


class Group:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, tables: str, make: Callable[..., DataFrame], sql: str | None = None) -> None:
        """Register make(*tables) under a name, with SQL over the same tables."""
        names = tables.split()

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(*[load(spark, sf_dir, t, deal=t in TEXTS) for t in names])

        self.queries[name] = query
        if sql:
            from docloom.sources.tables import DERIVED

            self.oracles[name] = with_sql(sql, *[t for t in names if t in DERIVED])

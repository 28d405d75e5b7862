"""How a query and its SQL are put side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from velarium.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries by function name; the SQL, if any, is the decorator's argument."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Register f(t), where t("orders") gives a table."""

        def put(f: Callable) -> Callable:
            self.queries[f.__name__] = lambda spark, folder: f(lambda name: table(spark, folder, name))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put

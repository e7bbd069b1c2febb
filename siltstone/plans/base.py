"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.session import spread

TEXTS = {"documents", "pages"}  # tables whose rows are costly to work on


class Registry:
    """Queries of one family: functions of (tables), their names and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function of a table reader under the function's name."""

        def add(function):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                def read(name: str) -> DataFrame:
                    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
                    return spread(table) if name in TEXTS else table

                return function(read)

            run.__doc__ = function.__doc__
            self.queries[function.__name__] = run
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add

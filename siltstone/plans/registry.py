"""Families of registered queries: each a function of (spark, sf_dir) and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Family:
    def __init__(self) -> None:
        self._queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function under its name, with the SQL that gives the same rows."""

        def add(f):
            self._queries[f.__name__] = f
            if sql:
                self._sql[f.__name__] = sql
            return f

        return add

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def sql_any(text: str, parts, test: str = "contains") -> str:
    return "(" + " OR ".join("{}({}, '{}')".format(test, text, p.replace("'", "''")) for p in parts) + ")"

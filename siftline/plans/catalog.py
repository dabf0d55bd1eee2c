"""Registry of runnable queries, each with an equivalent SQL text where one exists.

The SQL texts are written for another engine on purpose: they state what a
query must return in terms that share nothing with the Spark job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WIDENED = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}


def widened(df: DataFrame) -> DataFrame:
    """All whole numbers as bigint and all fractions as double."""
    return df.select(*(F.col(c).cast(WIDENED[t]).alias(c) if t in WIDENED else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widened(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def sql_values(rows, columns: list[str]) -> str:
    """A VALUES list as a sub-select."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS _v({', '.join(columns)}))"

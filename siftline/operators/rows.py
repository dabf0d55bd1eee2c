"""Shared row helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rule_rows(df: DataFrame) -> list:
    """All rows of a rule table.  Rules are parameters of a job, written by people, and travel inside its plan."""
    return df.collect()


def explode_structs(df: DataFrame, array_sql: str, keep: list[str]) -> DataFrame:
    """One row per struct in an array expression, struct fields as columns.

    ``inline`` would make the optimizer add a ``size(array) > 0`` filter below
    the generator and compute an expensive array twice, so this explodes
    outer and drops the empty rows above the generator.
    """
    long = df.select(*keep, F.explode_outer(F.expr(array_sql)).alias("_item"))
    return long.filter("_item IS NOT NULL").select(*keep, "_item.*")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys are those of ``left``."""
    renamed = right.select(*(F.col(k).alias(f"_right_{k}") for k in keys), *(F.col(c) for c in right.columns if c not in keys))
    same = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*(f"_right_{k}" for k in keys))

"""Running totals and sequence numbers over ordered rows, without a single-task window.

A window over the whole table, or over one very large group, would run in one
task.  Here the rows are range partitioned by group and order, each partition
is totalled, and the totals of earlier partitions are carried into later
ones.  Only the first group of a partition can continue an earlier one, so
the carried table has at most one row per partition and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.rows import join_null_safe
from siftline.session import cut_lineage


def running(
    df: DataFrame, order: list[str | Column], keys: list[str] | None = None,
    sums: dict[str, str] | None = None, number: str | None = None,
) -> DataFrame:
    """Add running sums (name -> SQL expression) and a 1-based row number per group.

    ``order`` must be a total order within a group for the result to be
    well defined.
    """
    keys = keys or []
    sums = dict(sums or {})
    if number:
        sums[number] = "1L"
    prepared = df.select("*", *(F.expr(e).alias(f"_v_{n}") for n, e in sums.items()))
    ranged = prepared.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    # the partition number must not change when a lost task runs again
    ranged = cut_lineage(ranged)

    totals = ranged.groupBy(*keys, "_part").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    # at most one row per partition and group
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_part", *(F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums),
        F.row_number().over(Window.partitionBy(*keys).orderBy("_part")).alias("_nth"),
    ).filter("_nth > 1").drop("_nth")

    joined = join_null_safe(ranged, F.broadcast(carried), [*keys, "_part"], "left")
    local = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *df.columns,
        *((F.sum(f"_v_{n}").over(local) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums),
    )

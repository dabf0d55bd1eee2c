"""Look-ups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
TRACKED_KEYS = 10_000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """At most HOT_KEYS keys, among them every key that holds a thousandth of the rows or more.

    A frequent-items sketch finds them in one pass with a bounded state per
    task; nothing is shuffled by key.
    """
    sketch = df.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k({key}, {HOT_KEYS}, {TRACKED_KEYS})").alias("top"))
    return sketch.select(F.explode("top.item").alias(key))


def lookup(left: DataFrame, right: DataFrame, key: str, keys_of: DataFrame | None = None) -> DataFrame:
    """Left join on ``key`` where ``right`` has at most one row per key.

    The most frequent keys of ``left`` take their match from a broadcast of at
    most HOT_KEYS rows, without moving any row of ``left``.  The others are
    shuffled; rows already served are spread by a key that matches nothing.
    The result is that of a plain left join, whichever keys count as frequent;
    ``keys_of`` is a cheaper table to look for them in, if ``left`` is the
    result of joins.
    """
    fields = [c for c in right.columns if c != key]
    hot = hot_keys(left if keys_of is None else keys_of, key)
    hot_right = hot.join(right, key, "left").select(
        F.col(key), F.struct(*(F.col(c) for c in fields)).alias("_hot")
    )
    first = left.join(F.broadcast(hot_right), key, "left")
    # a fixed hash rather than rand(): a task that runs again must place its rows as before
    plain = [c for c, t in left.dtypes if not t.startswith(("map", "array", "struct"))]
    scattered = F.concat(F.lit("\x00"), F.xxhash64(*plain).cast("string"))
    own = F.when(F.col("_hot").isNull(), F.col(key).cast("string"))
    first = first.withColumn("_k", F.coalesce(own, scattered))
    cold = right.select(F.col(key).cast("string").alias("_k"), F.struct(*(F.col(c) for c in fields)).alias("_cold"))
    joined = first.join(cold, "_k", "left")
    return joined.select(
        *(F.col(c) for c in left.columns),
        *(F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in fields),
    )

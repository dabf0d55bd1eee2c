"""Keyed tables that are brought up to date bucket by bucket.

A table is spread over buckets by an expression of its key.  An upsert reads
and rewrites only the buckets that its rows fall into, into a folder of a new
version, and commits by creating one small file that names the version of every
bucket.  Readers take the newest complete commit, so they see a version whole or
not at all; what a crash left uncommitted is never read and is overwritten by
the next attempt.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.session import cut_lineage


class KeyedTable:
    """A table under ``root``; ``bucket`` is an SQL expression (an int) over its columns."""

    def __init__(self, spark: SparkSession, root: str, bucket: str):
        self.spark, self.root, self.bucket = spark, root.rstrip("/"), bucket

    @classmethod
    def by_hash(cls, spark: SparkSession, root: str, key: str, buckets: int = 64) -> KeyedTable:
        return cls(spark, root, f"cast(pmod(xxhash64({key}), {buckets}) as int)")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, fs = self._fs(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def commit_of(self, version: int | None = None) -> dict:
        """A committed version (the newest by default): its number, schema and the version of each bucket."""
        for name in reversed(self._names("commits")):
            number = int(name.removesuffix(".json"))
            if version is None or number == version:
                text = self.spark.read.text(f"{self.root}/commits/{name}", wholetext=True).first()
                try:
                    found = json.loads(text[0])
                except (TypeError, ValueError):
                    continue  # its writer has not finished
                return found | {"version": number, "buckets": {int(b): v for b, v in found["buckets"].items()}}
        if version is not None:
            raise KeyError(f"no version {version} in {self.root}")
        return {"version": 0, "schema": None, "buckets": {}}

    def _commit(self, version: int, schema: StructType, buckets: dict[int, int]) -> None:
        path, fs = self._fs(f"commits/{version:010d}.json")
        out = fs.create(path, False)  # fails if another writer has this version
        try:
            out.write(bytearray(json.dumps({"schema": schema.json(), "buckets": buckets}).encode()))
        finally:
            out.close()

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a version (the newest by default), of all buckets or of some."""
        commit = self.commit_of(version)
        if commit["schema"] is None:
            raise ValueError(f"{self.root} holds no table yet")
        schema = StructType.fromJson(json.loads(commit["schema"]))
        wanted = commit["buckets"] if buckets is None else {b: commit["buckets"][b] for b in buckets if b in commit["buckets"]}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{v:010d}/_bucket={b}" for b, v in sorted(wanted.items())))

    def _write(self, df: DataFrame, version: int) -> list[int]:
        path = f"data/{version:010d}"
        placed = df.withColumn("_bucket", F.expr(self.bucket)).hint("rebalance", "_bucket")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_bucket").parquet(f"{self.root}/{path}")
        return [int(n.split("=")[1]) for n in self._names(path) if n.startswith("_bucket=") and "__HIVE" not in n]

    def create(self, df: DataFrame) -> int:
        """Version 1 of the table, or a version that replaces all rows."""
        version = self.commit_of()["version"] + 1
        written = self._write(df, version)
        self._commit(version, df.schema, dict.fromkeys(written, version))
        return version

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Rewrites the buckets of ``new`` with ``merge(old rows of these buckets, new)``; the buckets rewritten."""
        commit = self.commit_of()
        version = commit["version"] + 1
        placed = cut_lineage(new.withColumn("_bucket", F.expr(self.bucket)))
        touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())
        merged = merge(self.read(commit["version"], touched), placed.drop("_bucket"))
        written = self._write(merged, version)
        if not set(written) <= set(touched):
            raise ValueError("a merge may not move rows to other buckets")
        kept = {b: v for b, v in commit["buckets"].items() if b not in touched}
        self._commit(version, merged.schema, kept | dict.fromkeys(written, version))
        return touched

    def changed(self, since: int) -> list[int]:
        """Buckets that differ from version ``since``; only these need to be read for a difference."""
        before, now = self.commit_of(since)["buckets"], self.commit_of()["buckets"]
        return sorted(b for b in before.keys() | now.keys() if before.get(b) != now.get(b))

"""Session defaults and the shared folder for checkpoints and snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "siftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    A machine-local folder is only ever used on a local master (tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    current = context.getCheckpointDir()
    if current:
        return current
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; never reused."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage, so that lost executors cannot change it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: What a Python task takes at once; a task's memory grows with it, its speed hardly.
ROWS_AT_ONCE = 250
BYTES_AT_ONCE = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Python tasks take at most ROWS_AT_ONCE rows, and about BYTES_AT_ONCE, at once.

    With Spark's default of 10 000 rows a batch of long texts, its copies and
    results take some hundred MB in every worker.  A smaller setting stays.
    """
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= ROWS_AT_ONCE:
        conf.set(rows, str(ROWS_AT_ONCE))
    if conf.get(size, None) is None:
        conf.set(size, str(BYTES_AT_ONCE))
    return df

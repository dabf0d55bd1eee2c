"""Incremental triage, deduplication and daily counts as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as D
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from siftline.operators.store import latest_per_key
from siftline.session import cut_lineage


def stream_table(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


#: Entries of the state that the keys of a deduplication share.
STATE_BUCKETS = 2048

#: Folders over which a register is spread by key.
BUCKETS = 64


def _bucket(key: str, buckets: int):
    return F.expr(f"cast(pmod(xxhash64({key}), {buckets}) as int)").alias("bucket")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []


def folder_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files in ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isFile()]
    return sorted(n for n in names if n[0] not in "._")


def incremental_triage(
    incoming: DataFrame, analyse: Callable[[DataFrame], DataFrame], register: str, checkpoint: str, done: str = "true", version: str | None = None,
    retries: int = 0, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Analyse what has not been analysed yet; each micro-batch adds its rows to the register.

    The register is spread over ``buckets`` folders by id, and a micro-batch
    looks for finished ids only in the buckets that its own ids fall into; it
    neither lists nor reads the others.  A batch writes only its own folders
    ``bucket=…/batch=…``, so one that is run again after a failure overwrites
    what it wrote.  Batches are numbered on from what the register held when
    the checkpoint was new, so a lost or new checkpoint never touches earlier
    results, and what they finished is not done again.

    ``done`` says which register rows are finished.  Documents whose row is
    not (a failed analysis) wait with their input beside the register and are
    taken again by the next micro-batches, up to ``retries`` times, and
    whenever they come in again.  ``analyse`` sees the number of earlier
    attempts in a column ``attempt``.  Of several versions of a document in one
    batch the one with the largest ``version`` is taken (by default, the
    largest row).
    """
    base = _first_folder(incoming.sparkSession, register, checkpoint)
    waiting = f"{register.rstrip('/')}_waiting"

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, base + batch_id
        plain = [c for c, t in batch.dtypes if "map<" not in t]
        newest = F.max_by(F.struct(*batch.columns), F.struct(*([version] if version else plain)))
        rows = batch.groupBy("doc_id").agg(newest.alias("_row")).select("_row.*").withColumn("attempt", F.lit(0))
        if f"batch={folder - 1}" in _folders(spark, waiting):
            held = spark.read.parquet(f"{waiting}/batch={folder - 1}")
            again = held.select("doc_id", F.col("attempt").alias("_earlier"))
            rows = rows.join(again, "doc_id", "left").withColumn("attempt", F.coalesce("_earlier", "attempt")).drop("_earlier")
            rows = rows.unionByName(held.join(batch.select("doc_id"), "doc_id", "left_anti"))
        rows = cut_lineage(rows.withColumn("bucket", _bucket("doc_id", buckets)))
        # at most as many as there are buckets
        touched = {f"bucket={r[0]}" for r in rows.select("bucket").distinct().collect()}
        parts = [f"{register}/{name}" for name in _folders(spark, register) if name in touched]
        todo = rows
        if parts:
            finished = spark.read.option("basePath", register).parquet(*parts).filter((F.col("batch") < folder) & F.expr(done))
            finished = finished.join(rows.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct()
            todo = rows.join(finished, "doc_id", "left_anti")
        result = analyse(todo.drop("bucket"))
        kept = [c for c in result.columns if c not in ("bucket", "batch")]
        placed = result.select(*kept, _bucket("doc_id", buckets), F.lit(folder).alias("batch"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(register)
        if retries:
            parts = [f"{register}/{name}" for name in _folders(spark, register) if name in touched]
            failed = rows.limit(0)
            if parts:
                own = spark.read.option("basePath", register).parquet(*parts).filter((F.col("batch") == folder) & ~F.coalesce(F.expr(done), F.lit(False)))
                failed = todo.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
            failed = failed.drop("bucket").withColumn("attempt", F.col("attempt") + 1).filter(F.col("attempt") <= retries)
            failed.write.mode("overwrite").parquet(f"{waiting}/batch={folder}")

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _first_folder(spark: SparkSession, register: str, checkpoint: str) -> int:
    """The register folder of this checkpoint's batch 0, decided once and kept with the checkpoint."""
    note = f"{checkpoint}/first_register_folder"
    if register_exists(spark, note):
        return spark.read.parquet(note).first()[0]
    used = [int(n.split("=")[1]) for b in _folders(spark, register) for n in _folders(spark, f"{register}/{b}") if n.startswith("batch=")]
    first = max(used, default=-1) + 1
    spark.range(1).select(F.lit(int(first)).cast("long").alias("first")).coalesce(1).write.parquet(note)
    return int(first)


def register_exists(spark: SparkSession, register: str) -> bool:
    try:
        spark.read.parquet(register)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def current_register(spark: SparkSession, register: str) -> DataFrame:
    """The newest row of every document."""
    return latest_per_key(spark.read.parquet(register).drop("bucket"), "doc_id", "batch")


def stream_dedupe(stream: DataFrame, key: str, ts: str, delay: str = "1 hour", history: DataFrame | None = None, buckets: int = STATE_BUCKETS) -> DataFrame:
    """First event of each key within the watermark; with a stream ``history``, without the keys of that table.

    The history is itself a stream (key, ts): it is read once, by the
    micro-batch that meets its files, and goes into the state of its keys;
    later micro-batches look at the state of their own keys only.  A key's state
    leaves ``delay`` after its latest event, so the state does not grow
    with time.  Keys share ``buckets`` entries of the state, so that Python is
    called for each bucket of a micro-batch and not for each key.  History must
    be there before the events that it should hold back: of one micro-batch it
    is taken first.
    """
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if history is None:
        return stamped.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    kept = D.StructType([f for f in stamped.schema.fields])

    def filler(kind: D.DataType):
        # never returned; a null would turn a whole number of the rows beside it into a fraction
        return F.lit(0 if isinstance(kind, D.NumericType) else False if isinstance(kind, D.BooleanType) else None).cast(kind)

    known = history.select(F.lit(True).alias("_known"), *((F.col(f.name) if f.name in (key, ts) else filler(f.dataType)).cast(f.dataType).alias(f.name) for f in kept.fields))
    both = known.unionByName(stamped.withColumn("_known", F.lit(False))).withWatermark(ts, delay)
    name = F.col(key) if isinstance(kept[key].dataType, D.AtomicType) else F.to_json(F.struct(key))
    # a null key is one key
    both = both.withColumn("_name", F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("")))
    wait = int(pd.Timedelta(delay).total_seconds() * 1000)

    def first_of(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        until = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = None if state.hasTimedOut else pd.concat(list(parts)).sort_values(ts, kind="stable")
        met: dict[str, int] = {}
        if rows is not None:
            names = rows["_name"]
            fresh = rows[~names.duplicated() & ~names.isin(until) & ~names.isin(names[rows["_known"]])]
            latest = rows.dropna(subset=[ts]).drop_duplicates("_name", keep="last")
            met = dict.fromkeys(names, now)
            met.update(zip(latest["_name"], (latest[ts].astype("datetime64[us]").astype("int64") // 1000).tolist(), strict=True))
        for k, at in met.items():
            until[k] = max(until.get(k, 0), max(at, now) + wait + 1)
        # the keys of this micro-batch stay; of the others those that the watermark has passed leave
        until = {k: t for k, t in until.items() if k in met or t >= now}
        if until:
            state.update((list(until), list(until.values())))
            state.setTimeoutTimestamp(max(min(until.values()), now + 1))
        elif state.exists:
            state.remove()
        if rows is not None and len(fresh):
            yield fresh[kept.names]

    dealt = both.withColumn("_bucket", F.pmod(F.xxhash64("_name"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(first_of, kept, "names array<string>, until array<long>", "append", "EventTimeTimeout")


def daily_counts(stream: DataFrame, ts: str, group: list[str], delay: str = "1 day", slide: str | None = None, width: str = "1 day") -> DataFrame:
    """Counts per day, or per sliding window of several days, tolerating late events."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    watermarked = stamped.withWatermark(ts, delay) if stream.isStreaming else stamped
    return (
        watermarked.groupBy(window, *group)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *group, "n")
    )


def session_activity(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each key: runs of events at most ``gap`` apart, with their bounds and number of events."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    watermarked = stamped.withWatermark(ts, delay) if events.isStreaming else stamped
    return watermarked.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"
    )


def write_table(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return result.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def count_windows(
    stream: DataFrame, ts: str, group: list[str], path: str, checkpoint: str, delay: str = "1 day", width: str = "1 day", slide: str | None = None,
) -> StreamingQuery:
    """Counts per window, kept without state: each micro-batch adds one small table of its own counts (see ``counted_windows``).

    Rows more than ``delay`` behind the latest time of earlier micro-batches
    are late: they go whole to a side table (see ``late_rows``) and are not
    counted.  A micro-batch that is run again overwrites its own folders.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn(ts, F.col(ts).cast("timestamp")).persist()
        try:
            before = None
            if batch_id:
                before = spark.read.parquet(f"{path}/seen/batch={batch_id - 1}").first()[0]
            late = F.coalesce(F.col(ts) < F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
            daily_counts(batch.filter(~late), ts, group, width=width, slide=slide).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
            batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            newest = batch.agg(F.max(ts)).first()[0]
            seen = max((t for t in (before, newest) if t is not None), default=None)
            spark.createDataFrame([(seen,)], "seen timestamp").coalesce(1).write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_windows(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all micro-batches so far."""
    parts = spark.read.parquet(f"{path}/counts").drop("batch")
    return parts.groupBy(*(c for c in parts.columns if c != "n")).agg(F.sum("n").alias("n"))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/late").drop("batch")

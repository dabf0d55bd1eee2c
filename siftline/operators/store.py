"""Keyed tables: deduplication, upserts, diffs, staleness, and job state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.sql import quote
from siftline.operators.ordered import running
from siftline.operators.skew import lookup


def _filled(column: str) -> str:
    return f"trim(coalesce(cast({column} AS string), '')) <> ''"


def dedupe_best_row(table: DataFrame, keys: list[str], fallback: list[str], prefer: list[str], row_id: str) -> DataFrame:
    """One row per key: the most complete, then the newest.  Blank keys use the fallback key."""
    text = "coalesce(trim(cast({} AS string)), '')"
    main = ", ".join(text.format(k) for k in keys)
    other = ", ".join(text.format(k) for k in fallback)
    blank = " OR ".join(f"NOT ({_filled(k)})" for k in keys)
    key = f"CASE WHEN {blank} THEN array('f', {other}) ELSE array('k', {main}) END"
    complete = " + ".join(f"cast({_filled(c)} AS int)" for c in prefer) or "0"
    winners = table.groupBy(F.expr(key).alias("_key")).agg(
        F.expr(f"max(struct({complete} AS c, {row_id} AS r)).r").alias(row_id)
    )
    return table.join(winners.select(row_id), row_id, "left_semi")


def latest_per_key(table: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key; ``order`` is unique within a key."""
    rest = [c for c in table.columns if c not in (key, order)]
    newest = table.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_row"))
    return newest.select(key, *(F.col(f"_row.{c}").alias(c) for c in table.columns if c != key)).select(table.columns)


def stale_documents(docs: DataFrame, runs: DataFrame, current: dict[str, str]) -> DataFrame:
    """doc_id, stale: no run yet, or the latest run used another version of something supplied."""
    supplied = {c: v for c, v in current.items() if v != ""}
    latest = latest_per_key(runs.select("doc_id", "run_id", *supplied), "doc_id", "run_id")
    differs = " OR ".join(f"coalesce({c}, '') <> {quote(v)}" for c, v in supplied.items()) or "false"
    joined = docs.select("doc_id").join(latest, "doc_id", "left")
    return joined.select("doc_id", F.expr(f"run_id IS NULL OR {differs}").alias("stale"))


def insert_or_replace(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``table`` with those of the same key in ``new`` replaced; the last new row of a key wins."""
    rest = [c for c in new.columns if c not in (*keys, order)]
    last = new.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_row"))
    last = last.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in (order, *rest)))
    kept = table.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.select(kept.columns))


def upsert_register(
    old: DataFrame, new: DataFrame, system: list[str], protected: dict[str, object], now: str, order: str = "ord"
) -> DataFrame:
    """Register with new keys numbered on, and system columns of known keys brought up to date.

    old: key, seq, first_seen, system and protected columns.  new: key,
    ``order`` (unique) and system columns.  Protected columns, the number and
    the first-seen time of a known key never change.
    """
    incoming = new.groupBy("key").agg(
        F.min(order).alias("_first"), F.max(F.struct(order, *system)).alias("_last")
    ).select("key", "_first", *(F.col(f"_last.{c}").alias(f"_new_{c}") for c in system))
    known = old.join(incoming, "key", "left").select(
        "key", "seq", "first_seen",
        *(F.expr(f"CASE WHEN _first IS NOT NULL THEN _new_{c} ELSE {c} END").alias(c) for c in system),
        *protected,
    )
    top = old.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    added = running(incoming.join(old.select("key"), "key", "left_anti"), ["_first"], number="_n")
    added = added.select(
        "key",
        (F.col("_n") + F.lit(top)).cast(old.schema["seq"].dataType).alias("seq"),
        F.lit(now).cast(old.schema["first_seen"].dataType).alias("first_seen"),
        *(F.col(f"_new_{c}").alias(c) for c in system),
        *(F.lit(v).cast(old.schema[c].dataType).alias(c) for c, v in protected.items()),
    )
    return known.unionByName(added)


def upsert_review(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Reviews with status and note replaced; ``created_at`` of a known review is kept.

    old: doc_id, status, note, reviewed_at, updated_at, created_at.
    new: doc_id, ord, status, note.
    """
    last = new.groupBy("doc_id").agg(F.max(F.struct("ord", "status", "note")).alias("n"))
    stamp = f"cast({quote(now)} AS timestamp)"
    return old.join(last, "doc_id", "full_outer").select(
        "doc_id",
        F.expr("CASE WHEN n IS NOT NULL THEN n.status ELSE status END").alias("status"),
        F.expr("CASE WHEN n IS NOT NULL THEN n.note ELSE note END").alias("note"),
        F.expr(f"CASE WHEN n IS NOT NULL THEN {stamp} ELSE reviewed_at END").alias("reviewed_at"),
        F.expr(f"CASE WHEN n IS NOT NULL THEN {stamp} ELSE updated_at END").alias("updated_at"),
        F.expr(f"coalesce(created_at, {stamp})").alias("created_at"),
    )


def snapshot_diff(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do so that the queue holds each wanted key once, under its band.

    wanted: key (unique), band, name.  existing: key, band, name, path
    (unique).  Returns key, path, action (ADD, REFRESH, MOVE, REMOVE,
    REMOVE_COPY), band and name to have afterwards.
    """
    target = wanted.select("key", F.col("band").alias("to_band"), F.col("name").alias("to_name"))
    seen = lookup(existing, target, "key")
    # keep a copy that is already in place, else the first by path
    keep = seen.filter("to_band IS NOT NULL").groupBy("key").agg(
        F.expr("min(struct(band <> to_band AS misplaced, path)).path").alias("path")
    )
    marked = seen.join(keep.select("path", F.lit(True).alias("_keep")), "path", "left")
    action = (
        "CASE WHEN to_band IS NULL THEN 'REMOVE' WHEN _keep IS NULL THEN 'REMOVE_COPY'"
        " WHEN band <> to_band THEN 'MOVE' ELSE 'REFRESH' END"
    )
    changed = marked.select(
        "key", "path", F.expr(action).alias("action"),
        F.expr("CASE WHEN _keep THEN to_band END").alias("band"), F.expr("CASE WHEN _keep THEN to_name END").alias("name"),
    )
    missing = target.join(existing.select("key").distinct(), "key", "left_anti").select(
        "key", F.lit(None).cast("string").alias("path"), F.lit("ADD").alias("action"),
        F.col("to_band").alias("band"), F.col("to_name").alias("name"),
    )
    return changed.unionByName(missing)


def union_hits(*tables: DataFrame) -> DataFrame:
    """Hits of several sources, each once."""
    return reduce(DataFrame.unionByName, tables).distinct()


def reconcile_items(files: DataFrame, items: DataFrame) -> DataFrame:
    """File states after an interrupted job: finished items count, all others are tried again.

    files: file_id, status, doc_id.  items: item_id, file_id, status, doc_id.
    """
    folded = items.groupBy("file_id").agg(
        F.expr("bool_or(status = 'COMPLETED')").alias("done"),
        F.expr("bool_or(status = 'DUPLICATE')").alias("dup"),
        F.expr("max_by(CASE WHEN status = 'COMPLETED' THEN doc_id END, CASE WHEN status = 'COMPLETED' THEN item_id END)").alias("done_doc"),
    )
    status = (
        "CASE WHEN done IS NULL THEN status WHEN done THEN 'completed' WHEN dup THEN 'duplicate'"
        " WHEN status IN ('completed', 'duplicate') THEN status ELSE 'accepted' END"
    )
    return files.join(folded, "file_id", "left").select(
        "file_id", F.expr(status).alias("status"), F.expr("CASE WHEN done THEN done_doc ELSE doc_id END").alias("doc_id")
    )


def job_counters(items: DataFrame) -> DataFrame:
    """Per job: processed, success, failed, duplicate, and successes per band."""
    final = "status IN ('COMPLETED', 'FAILED', 'DUPLICATE')"
    return items.groupBy("job_id").agg(
        F.expr(f"count_if({final})").alias("processed"),
        F.expr("count_if(status = 'COMPLETED')").alias("success"),
        F.expr("count_if(status = 'FAILED')").alias("failed"),
        F.expr("count_if(status = 'DUPLICATE')").alias("duplicate"),
        *(F.expr(f"count_if(status = 'COMPLETED' AND coalesce(band, 'D') = '{b}')").alias(f"{b.lower()}_count") for b in "SABCD"),
    )


def table_fingerprint(table: DataFrame) -> DataFrame:
    """One row: a hash of a table's rows that ignores their order.

    Row hashes are added up in four parts, so the sum is partial on the map
    side and no rows are gathered or sorted.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256).alias("h")
    parts = [f"sum(cast(conv(substring(h, {1 + 15 * i}, 15), 16, 10) AS decimal(38, 0)))" for i in range(4)]
    joined = ", ".join(f"coalesce(cast({p} AS string), '0')" for p in parts)
    return table.select(row).agg(
        F.expr(f"sha2(concat_ws('|', cast(count(*) AS string), {joined}), 256)").alias("fingerprint"), F.count("*").alias("n_rows")
    )


def publish(df: DataFrame, root: str, version: int) -> str:
    """Write a snapshot to a new folder, then name it in the log.  Readers never see half a table."""
    path = f"{root}/v{version:010d}"
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    spark.range(1).selectExpr(f"cast({version} AS bigint) AS version", f"{quote(path)} AS path").coalesce(1).write.mode("append").json(f"{root}/log")
    return path


def published(spark: SparkSession, root: str) -> tuple[int, str]:
    """Version and path of the latest snapshot."""
    row = spark.read.schema("version long, path string").json(f"{root}/log").orderBy(F.desc("version")).first()
    return row.version, row.path

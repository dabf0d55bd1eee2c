"""Shared plumbing of the operators: reading a table, running block functions, a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The two columns an operator reads, under fixed names, so that other columns of the caller cannot clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def stored(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again; its Python tasks take about ``batch_bytes`` at once.

    Lineage ends at files that every executor can read, so a lost executor
    costs its running tasks only.
    """
    path = scratch_path(df.sparkSession, label)
    conf = df.sparkSession.conf
    # the shuffle files of this one job are not needed again
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_bytes:
        settings["spark.sql.execution.arrow.maxBytesPerBatch"] = str(batch_bytes)
    before = {name: conf.get(name, None) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64, copy=False))


def in_slices(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A large result in pieces, so that the executor never holds all of it in transfer buffers."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def per_batch(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of one Arrow batch as a function for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return run


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of a partition as one table, or nothing when it is empty."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks() if found else None


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, size: int) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by the whole number ``key``, some whole groups at a time: about ``size`` bytes, or one group that is larger."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held >= size:
            last = waiting[-1].column(key)[-1].as_py()
            cut = int(np.searchsorted(batch.column(key).to_numpy(), last, "right"))
            if cut < batch.num_rows:
                found = pa.Table.from_batches([*waiting, batch.slice(0, cut)]).combine_chunks()
                waiting, held, batch = [], 0, batch.slice(cut)
                yield found
                del found
        waiting.append(batch)
        held += batch.nbytes
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by ``keys``, one group at a time."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for key in keys:
            column = batch.column(key)
            new[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        new[0] = not waiting or any(waiting[0].column(k)[0] != batch.column(k)[0] for k in keys)
        bounds = np.append(np.flatnonzero(new), n)
        if waiting and bounds[0] == 0:
            yield pa.Table.from_batches(waiting)
            waiting = []
        elif bounds[0]:
            waiting.append(batch.slice(0, int(bounds[0])))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if waiting and new[lo]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(lo, hi - lo))
    if waiting:
        yield pa.Table.from_batches(waiting)


def held_out(remainder: int, key: str = "doc_id"):
    return (F.crc32(F.col(key).cast("string").cast("binary")) % 5) == remainder

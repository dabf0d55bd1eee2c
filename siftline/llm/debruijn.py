"""Operator 2, substring dedup: a compacted de Bruijn graph of word sequences.

A run of ``window`` words is a k-mer of the graph: an edge from the node of its
first window - 1 words to that of its last window - 1.  A word goes if a k-mer
covers it that also starts in a document of smaller id.

* Runs of k-mers with one anchor (see ``winnow``) are read as one edge, so a
  text has an edge for about every 17 words.  An anchor with several different
  spans gets its k-mers as single edges, taken from the first document of each
  span; later documents with an equal span have all its k-mers in an earlier
  one.
* Edges are grouped over the corpus; those of one document leave the graph.
* Nonbranching paths compact by joins: an edge goes on from the one before it
  when their node has one way in and one way out, both stand side by side in
  their first document, and both have the same number of copies.  Numbering
  the edges along their first document's coordinates joins whole chains at
  once, without rounds of pointer jumping.
* Occurrences of a path in later documents are joined back by edge and
  verified by coordinates: only edges that stand side by side in the document,
  at one distance from the path, make up a long repeated span.

Edges are named by two independent 64-bit hashes.  All grouping is by partial
sums or minima and all joins are plain equi-joins whose one side is unique, so
Spark may split any hot key.

Null and empty texts have no words.  Rows with a null id are neither removed
from nor a reason to remove.  Rows that share an id are never a reason to
remove from each other.  Columns other than the two named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.arrays import Block, Prefix, Words, blocks, covered, mix, ragged
from siftline.llm.frames import in_slices, keyed_texts, longs, per_batch, stored, table
from siftline.llm.winnow import segments

WINDOW = 50
ANCHOR = 16

SEGMENTS = "e1 long, e2 long, anchor long, source long, target long, doc_id long, version int, start int, n int"
KMERS = "e1 long, e2 long, source long, target long, doc_id long, version int, start int, n int"


def _batch(block_rows: pa.RecordBatch, rows: np.ndarray, start: np.ndarray, n: np.ndarray, **hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {k: longs(v) for k, v in hashes.items()}
        | {"doc_id": block_rows.column("doc_id").take(pa.array(rows)), "version": block_rows.column("version").take(pa.array(rows)),
           "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32))}
    )


def _ends(prefix: Prefix, start: np.ndarray, n: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Hashes of the nodes that a run of n k-mers leads from and to."""
    return {"source": mix(prefix.run(start, start + window - 1)), "target": mix(prefix.run(start + n, start + n + window - 1))}


def segment_edges(rows: DataFrame, window: int, k: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column("text")):
            words = Words(block)
            prefix = Prefix(words.hash)
            s = segments(prefix, words.first, window, k)
            yield from in_slices(
                _batch(batch, block.rows.start + s.owner, s.start - words.first[s.owner], s.count,
                       e1=mix(s.span + s.anchor), e2=s.span, anchor=s.anchor, **_ends(prefix, s.start, s.count, window))
            )

    return rows.mapInArrow(per_batch(run), SEGMENTS)


def kmer_edges(texts: DataFrame, window: int) -> DataFrame:
    """Single k-mers of the listed runs of each text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column("text")):
            words = Words(block)
            prefix, check = Prefix(words.hash), Prefix(mix(words.hash + np.uint64(7)))
            lists = batch.column("runs")[block.rows]
            owner = np.repeat(np.arange(len(block)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            n = flat.field("n").to_numpy().astype(np.int64)
            owner, at = np.repeat(owner, n), ragged(words.first[owner] + flat.field("start").to_numpy(), n)
            one = np.ones(len(at), np.int64)
            yield from in_slices(
                _batch(batch, block.rows.start + owner, at - words.first[owner], one, e1=mix(prefix.run(at, at + window)),
                       e2=mix(check.run(at, at + window)), **_ends(prefix, at, one, window))
            )

    return texts.mapInArrow(per_batch(run), KMERS)


def grouped_edges(edges: DataFrame, *more: str) -> DataFrame:
    """Distinct edges with their first place, last document and number of copies."""
    first = F.min(F.struct("doc_id", "version", "start", "n", "source", "target")).alias("first")
    return edges.groupBy("e1", "e2", *more).agg(first, F.max("doc_id").alias("last"), F.count("*").alias("copies"))


def compacted(edges: DataFrame) -> DataFrame:
    """Names the nonbranching path of every edge, and the edge's distance from the path's start.

    ``edges``: e1, e2, first, copies.  A path is named by its first place.
    """
    flat = edges.select("e1", "e2", "first.*", "copies")
    ways = flat.select(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        flat.select(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    through = ways.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out = 1 AND into = 1")
    joined = flat.join(through.select(F.col("node").alias("source"), F.lit(True).alias("through")), "source", "left")
    along = Window.partitionBy("doc_id", "version").orderBy("start", "n", "e1")
    goes_on = F.coalesce(
        F.col("through") & (F.lag(F.col("start") + F.col("n")).over(along) == F.col("start"))
        & (F.lag("target").over(along) == F.col("source")) & (F.lag("copies").over(along) == F.col("copies")),
        F.lit(False),
    )
    begun = joined.withColumn("begin", F.when(~goes_on, F.col("start")))
    path_start = F.last("begin", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("path_start", path_start).select(
        "e1", "e2", "n", "copies", F.col("doc_id").alias("path_doc"), F.col("version").alias("path_version"), "path_start",
        (F.col("start") - F.col("path_start")).alias("offset"),
    )


def _graph(rows: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges of all texts, places of edges whose anchor has several spans, their single k-mers, and the named paths."""
    found = stored(segment_edges(rows, window, k), "segments")
    edges = grouped_edges(found, "anchor")
    anchors = edges.groupBy("anchor").agg(F.count("*").alias("spans"), F.min("first.doc_id").alias("least"), F.max("last").alias("most"))
    shared = stored(edges.join(anchors.filter("least < most").select("anchor", "spans"), "anchor"), "edges")
    several = shared.filter("spans > 1").select("e1", "e2", F.col("first.doc_id").alias("least"))
    in_first = stored(found.join(several, ["e1", "e2"]).select("doc_id", "version", "start", "n", "least"), "open-edges")
    runs = in_first.filter("doc_id = least").groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    kmers = stored(kmer_edges(rows.join(runs.hint("merge"), ["doc_id", "version"]), window), "kmers")
    repeated = shared.filter("spans = 1").select("e1", "e2", "first", "last", "copies").union(
        grouped_edges(kmers).select("e1", "e2", "first", "last", "copies")
    ).filter("first.doc_id < last")
    return found, in_first, kmers, stored(compacted(repeated), "paths")


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return keyed_texts(docs, text, key).withColumn("version", F.shiftright(F.xxhash64("text"), 49).cast("int"))


def repeated_paths(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """The compacted graph: each repeated path with its first place, length in words and copies."""
    rows = _keyed(docs, text, key).filter("doc_id IS NOT NULL")
    return _graph(rows, window, k)[3].groupBy("path_doc", "path_version", "path_start", "copies").agg(
        F.count("*").alias("edges"), (F.sum("n") + window - 1).alias("n_words")
    ).drop("path_version")


def repeated_spans(rows: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, version, start, length): long spans of words that repeat an earlier document."""
    found, several, kmers, paths = _graph(rows, window, k)
    place = ["doc_id", "version", "start", "n"]
    on_path = found.select("e1", "e2", *place).union(kmers.select("e1", "e2", *place)).join(paths.drop("n"), ["e1", "e2"]).filter(
        "doc_id > path_doc"
    ).select(*place, "path_doc", "path_version", "path_start", (F.col("start") - F.col("offset")).alias("distance"))
    whole = several.filter("doc_id > least").select(*place)
    side = Window.partitionBy("doc_id", "version", "path_doc", "path_version", "path_start", "distance").orderBy("start")
    apart = F.coalesce(F.lag(F.col("start") + F.col("n")).over(side) < F.col("start"), F.lit(True))
    spans = on_path.withColumn("begin", F.when(apart, F.col("start"))).withColumn(
        "begin", F.last("begin", ignorenulls=True).over(side.rowsBetween(Window.unboundedPreceding, 0))
    ).groupBy("doc_id", "version", "path_doc", "path_version", "path_start", "distance", "begin").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    length = (F.col("end") - F.col("begin") + window - 1).alias("length")
    return spans.select("doc_id", "version", F.col("begin").alias("start"), length).union(
        whole.select("doc_id", "version", "start", (F.col("n") + window - 1).alias("length"))
    )


def kept_words(block: Block, owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(block, hashes=False)
    begin = words.first[owner] + start
    return words, covered(begin, begin + length, len(words.start))


def word_repeat_report(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: words, removed words, and the hash of the kept ones joined by spaces."""
    rows = _keyed(docs, text, key)
    spans = repeated_spans(rows.filter("doc_id IS NOT NULL"), window, k)
    lists = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "length")).alias("spans"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column("text")):
            found = batch.column("spans")[block.rows]
            sizes = np.array([x or 0 for x in pa.compute.list_value_length(found).to_pylist()], np.int64)
            flat = found.flatten()
            words, gone = kept_words(
                block, np.repeat(np.arange(len(block)), sizes), flat.field("start").to_numpy().astype(np.int64), flat.field("length").to_numpy().astype(np.int64)
            )
            total = np.concatenate(([0], np.cumsum(gone)))
            # the kept words of the block, each followed by a space
            keep = np.flatnonzero(~gone)
            size = words.end[keep] - words.start[keep]
            ends = np.cumsum(size + 1)
            joined = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            joined[ragged(ends - size - 1, size)] = block.data[ragged(words.start[keep], size)]
            bounds = np.concatenate(([0], ends))[words.first - total[words.first]]
            digests = [hashlib.sha256(joined[lo : max(lo, hi - 1)].tobytes()).hexdigest() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")[block.rows], "n_words": longs(words.count),
                 "n_removed": longs(total[words.first[1:]] - total[words.first[:-1]]), "kept_sha256": pa.array(digests, pa.string())}
            )

    return rows.join(lists.hint("merge"), ["doc_id", "version"], "left").mapInArrow(per_batch(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op2_debruijn(spark, sf_dir: str) -> DataFrame:
    """What repeats of 50 words leave of every text of ``documents``."""
    return word_repeat_report(table(spark, sf_dir, "documents"))

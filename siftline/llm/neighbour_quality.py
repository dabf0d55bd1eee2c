"""Operator 7, quality classifier: nearest labelled neighbours in a latent-semantic space.

A text becomes a vector of hashed words, hashed word shapes (letters, capitals,
digits and marks, runs shortened) and a few shares of its form in bands
(repeated words, repeated lines, length).  Word and shape weights use document
frequencies over all documents.  A truncated singular-value decomposition of
the labelled sample gives RANK latent directions.

The sample is bounded: the SAMPLE labelled rows whose id hashes lowest.  Its
latent vectors are broadcast (about SAMPLE * RANK * 4 bytes, 1 MiB), and each
task multiplies them with the vectors of its texts in blocks: every text meets
every labelled vector.  The labels of the NEIGHBOURS nearest vote with weight
cosine ** SHARPNESS; a prior of weight PRIOR keeps scores inside (0, 1).

Two narrow passes over the documents and no shuffle of texts.  Null and empty
texts have no direction and get the share of label 1.  Null or unknown labels
are not learnt from; without any label all scores are 0.5.  Repeated rows get
equal results, a null id counts as not held out.  Columns other than the named
ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrays import IS_WORD, Block, Prefix, Words, blocks, byte_values, mix
from siftline.llm.frames import held_out, keyed_texts, longs, per_batch, table
from siftline.llm.repetition import duplicate_lines

SAMPLE = 4096
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 8.0
PRIOR = 0.05
THRESHOLD = 0.3

WORD_BUCKETS, SHAPE_BUCKETS, BANDS = 2048, 512, 16
FORMS = 5
WIDTH = WORD_BUCKETS + SHAPE_BUCKETS + BANDS * FORMS
#: Weight of words, shapes and form bands in a vector.
PARTS = [(slice(0, WORD_BUCKETS), 0.5), (slice(WORD_BUCKETS, WORD_BUCKETS + SHAPE_BUCKETS), 1.0), (slice(WORD_BUCKETS + SHAPE_BUCKETS, WIDTH), 1.0)]
TEXTS_AT_ONCE = 512

# letters, capitals, digits and all further characters in one class each; marks stay themselves
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = 0x61
_CLASS[0x80:] = 0x61
_CLASS[0x41:0x5B] = 0x41
_CLASS[0x30:0x3A] = 0x30


def _banded(value: np.ndarray) -> np.ndarray:
    return np.clip((value * BANDS).astype(np.int64), 0, BANDS - 1)


def counts(block: Block) -> np.ndarray:
    """Raw counts of every feature for each text of a block."""
    n = len(block)
    words = Words(block, lower=True)
    doc = words.doc()
    flat = np.bincount(doc * WORD_BUCKETS + (words.hash & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), minlength=n * WORD_BUCKETS)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :WORD_BUCKETS] = flat.reshape(n, WORD_BUCKETS)
    # shapes: runs of one class count once
    classes = _CLASS[block.data]
    changes = np.ones(len(classes), bool)
    changes[1:] = classes[1:] != classes[:-1]
    changes[words.start] = True
    position = np.concatenate(([0], np.cumsum(changes)))
    prefix = Prefix(byte_values(classes[changes]))
    shape = mix(prefix.run(position[words.start], position[words.end]))
    flat = np.bincount(doc * SHAPE_BUCKETS + (shape & np.uint64(SHAPE_BUCKETS - 1)).astype(np.int64), minlength=n * SHAPE_BUCKETS)
    out[:, WORD_BUCKETS : WORD_BUCKETS + SHAPE_BUCKETS] = flat.reshape(n, SHAPE_BUCKETS)
    # forms, as shares from 0 to 1
    size = np.maximum(words.count, 1)
    tagged = mix(words.hash + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    by = np.argsort(tagged)
    first = np.ones(len(by), bool)
    first[1:] = tagged[by[1:]] != tagged[by[:-1]]
    distinct = np.bincount(doc[by[first]], minlength=n)
    lines = np.bincount(np.searchsorted(block.offsets, np.flatnonzero(block.data == 0x0A), "right") - 1, minlength=n)[:n] + 1
    letters = np.concatenate(([0], np.cumsum((classes == 0x61) | (classes == 0x41))))[block.offsets]
    capitals = np.concatenate(([0], np.cumsum(classes == 0x41)))[block.offsets]
    solid = np.concatenate(([0], np.cumsum(IS_WORD[block.data])))[block.offsets]
    inner = np.maximum(np.diff(solid), 1)
    forms = [
        1 - (distinct / size) ** 0.5, duplicate_lines(block, IS_WORD[block.data]) / np.maximum(lines, 1),
        np.minimum(np.log2(size + 1) / 16, 1), np.diff(letters) / inner, np.diff(capitals) / np.maximum(np.diff(letters), 1),
    ]
    filled = words.count > 0
    for k, form in enumerate(forms):
        at = WORD_BUCKETS + SHAPE_BUCKETS + k * BANDS + _banded(form)
        out[np.flatnonzero(filled), at[filled]] = 1
    return out


def weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times document weight, each part at its own length."""
    x = np.log1p(raw) * idf
    for part, weight in PARTS:
        length = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        x[:, part] *= weight / np.maximum(length, 1e-9)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Neighbours:
    """Latent directions, the labelled vectors and their labels."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, labels: np.ndarray, idf: np.ndarray) -> Neighbours:
        if not len(labels):
            return cls(idf, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels)
        x = weighted(raw, idf)
        rank = min(RANK, len(x), WIDTH)
        # a randomised range finder with two power steps, then a small exact decomposition
        sketch = x @ np.random.default_rng(7).standard_normal((WIDTH, rank + 8)).astype(np.float32)
        for _ in range(2):
            sketch = x @ (x.T @ np.linalg.qr(sketch)[0])
        basis = np.linalg.qr(sketch)[0]
        _, _, right = np.linalg.svd(basis.T @ x, full_matrices=False)
        directions = np.ascontiguousarray(right[:rank].T, dtype=np.float32)
        return cls(idf, directions, unit(x @ directions), labels.astype(np.float32))

    def score(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(raw), 0.5)
        near = unit(weighted(raw, self.idf) @ self.directions) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** SHARPNESS
        prior = float(self.labels.mean())
        return ((weight * self.labels[best]).sum(axis=1) + PRIOR * prior) / (weight.sum(axis=1) + PRIOR)


def document_weights(rows: DataFrame) -> np.ndarray:
    """Inverse document frequency of every feature over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for block in blocks(batch.column("text"), texts=TEXTS_AT_ONCE):
                total += (counts(block) > 0).sum(axis=0)
                n += len(block)
        yield pa.RecordBatch.from_pydict({"feature": longs(np.arange(WIDTH + 1)), "n": longs(np.append(total, n))})

    found = rows.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(WIDTH + 1)
    for r in found:
        n[r["feature"]] = r["n"]
    idf = np.log((n[-1] + 1) / (n[:-1] + 1)) + 0.1
    idf[WORD_BUCKETS + SHAPE_BUCKETS :] = 1
    return idf.astype(np.float32)


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, label_key: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts and labels of at most ``size`` labelled rows."""
    chosen = labels.select(F.col(label_key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        "label IN (0, 1) AND doc_id IS NOT NULL"
    ).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(size)
    # at most ``size`` rows: small enough to broadcast
    found = rows.join(F.broadcast(chosen), "doc_id")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column("text"), texts=TEXTS_AT_ONCE):
            raw = counts(block)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")[block.rows], "label": batch.column("label")[block.rows], "raw": pa.array([x.tobytes() for x in raw], pa.binary())}
            )

    got = found.select("doc_id", "label", "text").mapInArrow(per_batch(run), "doc_id long, label int, raw binary").orderBy("doc_id", "label", "raw").limit(size).toArrow()
    raw = np.frombuffer(b"".join(got.column("raw").to_pylist()), np.float32).reshape(-1, WIDTH)
    return raw, got.column("label").to_numpy()


def quality_scores(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", label_key: str = "doc_id",
    hold_out: Column | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """Score and prediction of every row of ``docs``; labels of rows where ``hold_out`` (of doc_id) holds are not learnt from."""
    rows = keyed_texts(docs, text, key)
    held = F.coalesce(hold_out, F.lit(False)) if hold_out is not None else F.lit(False)
    usable = labels.select(F.col(label_key).cast("long").alias("doc_id"), F.col(label).alias("label")).filter(~held)
    raw, known = labelled_sample(rows, usable, "label", "doc_id", sample)
    model = docs.sparkSession.sparkContext.broadcast(Neighbours.fit(raw, known, document_weights(rows)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column("text"), texts=TEXTS_AT_ONCE):
            score = np.clip(model.value.score(counts(block)), 0, 1)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")[block.rows], "held_out": batch.column("held_out")[block.rows],
                 "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}
            )

    return rows.withColumn("held_out", held).select("doc_id", "held_out", "text").mapInArrow(
        per_batch(run), "doc_id long, held_out boolean, score double, predicted int"
    )


def op7_neighbour_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every text of ``documents`` as ``labels`` marks it."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), hold_out=held_out(0))

"""Operator 12, packing along a space-filling curve: neighbouring documents share a sequence.

* A document's words are hashed into a vector of BUCKETS dampened counts of
  length one, and projected to DIMS dimensions with a fixed random matrix.  The
  cell of that point on a fine grid has a place on the Hilbert curve, so
  documents with nearby keys have similar words, and copies have equal keys.
* Documents are sorted by range of (key, id), so a key that very many share is
  split by id.  The running number of ids before a document, carried from
  partition to partition as one row each, is its place on the curve; sequences
  are the curve cut every ``length`` ids.  Only the last sequence is less than
  full.  The result depends on the documents alone, not on partitions.

Ids are made once and written with 16 bits each where the vocabulary allows it;
sorting moves one light row a document, and one join brings ids and places
together.  Nothing grows with the corpus in any task: a task holds a block of
whole documents.

A token never spans white space or a change between an ASCII letter, digit
and mark (an apostrophe may begin a token with letters after it), so texts are
tokenised by such units, each distinct one once.  Texts with the name of an
added token are only cut at white space.

Null and empty texts are the end id alone.  Rows with a null id sort first.
Repeated rows are packed again; ties of key and id are broken by input row.
Very long documents are cut at sequence bounds only.  An empty table gives an
empty result.  Columns other than the two named ones are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrays import LOWER, Block, blocks, ragged, span_hashes
from siftline.llm.frames import in_slices, keyed_texts, longs, per_batch, stored, table
from siftline.llm.units import Memo
from siftline.operators.ordered import running

LENGTH = 2048
END_ID = 1
PAD_ID = 0
BUCKETS = 1 << 12
DIMS = 4
#: Bits of a coordinate, and its range in standard deviations of the projection.
BITS = 15
REACH = 4.0
#: Distinct units that a worker remembers.
REMEMBERED = 1 << 20

TOKENS = "row long, doc_id long, key long, n long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
SEQUENCES = "sequence_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"

_SPACE, _LETTER, _DIGIT, _MARK, _APOSTROPHE = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0C, 0x0D]] = _SPACE
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _APOSTROPHE
_CUT = np.zeros((6, 6), bool)
_CUT[2:5, 2:5] = True
_CUT[_LETTER, _LETTER] = _CUT[_MARK, _MARK] = False
_CUT[[_LETTER, _DIGIT], _APOSTROPHE] = True


def units(block: Block, whole: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of units that can be tokenised alone; texts that hold one of ``whole`` are cut at white space only."""
    data = block.data
    kind = _KIND[data]
    # letters of two bytes up to U+017F; the signs of multiplication and division are none, and one letter becomes two when lowered
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    pair = (data[lead].astype(np.int64) << 8) | data[lead + 1]
    lead = lead[(pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)]
    kind[lead] = kind[lead + 1] = _LETTER
    if whole and any(w in (text := data.tobytes()) for w in whole):
        for lo, hi in zip(block.offsets[:-1], block.offsets[1:], strict=True):
            if any(w in text[lo:hi] for w in whole):
                kind[lo:hi] = np.where(kind[lo:hi] == _SPACE, _SPACE, 0)
    inside = kind != _SPACE
    begins, stops = inside.copy(), inside.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[block.offsets] = True
    apart = edge[1:-1] | _CUT[kind[:-1], kind[1:]]
    begins[1:] &= ~inside[:-1] | apart
    stops[:-1] &= ~inside[1:] | apart
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(block.offsets, start, "right") - 1


@lru_cache(1)
def _memo(vocabulary: str) -> tuple[Memo, tuple[bytes, ...]]:
    """A worker's tokenizer with its memory, and the names of added tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)

    def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in tokenizer.encode_batch_fast([u.decode() for u in new], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(counts.sum())), counts

    return Memo(encode, REMEMBERED), tuple(t.content.encode() for t in tokenizer.get_added_tokens_decoder().values())


def projection(buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(1201).standard_normal((buckets, dims))


def coordinates(owner: np.ndarray, word: np.ndarray, bucket: np.ndarray, texts: int, matrix: np.ndarray) -> np.ndarray:
    """Projected word vectors of texts: ``word`` numbers the words, ``bucket`` has the place of each number (-1: not a word)."""
    both = np.sort(owner * len(bucket) + word) if len(word) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else both
    weight = 1 + np.log(np.diff(np.append(first, len(both))))
    text, place = both[first] // max(1, len(bucket)), bucket[both[first] % max(1, len(bucket))]
    some = place >= 0
    text, place, weight = text[some], place[some], weight[some]
    # words of one text in one bucket add up before the length is taken
    cell, at = np.unique(text * len(matrix) + place, return_inverse=True)
    value = np.bincount(at.reshape(-1), weight, len(cell))
    text, place = cell // len(matrix), cell % len(matrix)
    norm = np.sqrt(np.bincount(text, value * value, texts))
    out = np.stack([np.bincount(text, value * matrix[place, d], texts) for d in range(matrix.shape[1])], axis=1)
    return out / np.maximum(norm, 1e-12)[:, None]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates of ``bits`` bits, by Gray codes of rotated cells."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            high = (x[d] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def grid(points: np.ndarray, bits: int = BITS, reach: float = REACH) -> np.ndarray:
    return np.clip((points + reach) / (2 * reach) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


def _binary(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """Consecutive stretches of an array as binary values."""
    offsets = np.concatenate(([0], np.cumsum(count))) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def tokenized(rows: DataFrame, vocabulary: str, end_id: int, wide: bool) -> DataFrame:
    """Curve key and ids of every row; ``row`` numbers the rows and holds only for one run."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (memo, names), matrix = _memo(shared.value), projection()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in blocks(batch.column("text")):
                start, end, owner = units(block, names)
                which, place, slots = memo.distinct(block, start, end)
                body, sizes = memo.ids_at(slots[which])
                count = np.bincount(owner, sizes, len(block)).astype(np.int64)
                ids = np.full(len(body) + len(block), end_id, "<u4" if wide else "<u2")
                ids[np.arange(len(body)) + np.repeat(np.arange(len(block)), count)] = body
                letters = _KIND[block.data[start[place]]] == _LETTER
                letters |= block.data[start[place]] >= 0x80
                bucket = (span_hashes(LOWER[block.data], start[place], end[place]) & np.uint64(BUCKETS - 1)).astype(np.int64)
                key = hilbert(grid(coordinates(owner, which, np.where(letters, bucket, -1), len(block), matrix)), BITS)
                found = pa.RecordBatch.from_pydict(
                    {"row": longs(row + np.arange(len(block))), "doc_id": batch.column("doc_id")[block.rows], "key": longs(key), "n": longs(count + 1),
                     "ids": _binary(ids, count + 1).cast(pa.binary())}
                )
                row += len(block)
                yield from in_slices(found, 1 << 12)

    return rows.mapInArrow(run, TOKENS)


def pieces_of(placed: DataFrame, length: int, wide: bool) -> DataFrame:
    """Cuts documents (doc_id, n, ids, before) where sequences end."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < batch.num_rows:
            # about 2^21 ids at once
            n = batch.column("n")[at:].to_numpy()
            some = max(1, int(np.searchsorted(np.cumsum(n), 1 << 21)))
            part = batch.slice(at, some)
            at += some
            n, before = part.column("n").to_numpy(), part.column("before").to_numpy()
            ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), "<u4" if wide else "<u2").astype("<u4")
            first, last = before // length, (before + n - 1) // length
            count = last - first + 1
            owner, sequence = np.repeat(np.arange(len(n)), count), ragged(first, count)
            begin = np.maximum(sequence * length, before[owner])
            size = np.minimum((sequence + 1) * length, before[owner] + n[owner]) - begin
            found = {
                "doc_id": part.column("doc_id").take(longs(owner)), "start": longs(begin - before[owner]), "length": longs(size), "doc_tokens": longs(n[owner]),
                "sequence_id": longs(sequence), "offset": longs(begin - sequence * length), "ids": _binary(ids, size).cast(pa.binary()),
            }
            yield from in_slices(pa.RecordBatch.from_pydict(found), 1 << 12)

    return placed.select("doc_id", "n", "ids", "before").mapInArrow(per_batch(run), PIECES)


def pack_along_curve(
    docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: a stretch of a document's ids (little-endian, 32 bits) and its place in a sequence of ``length``."""
    import json

    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    model = json.loads(vocabulary)
    wide = max(end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])) >= 1 << 16
    tokens = stored(tokenized(keyed_texts(docs, text, key), vocabulary, end_id, wide), "tokens")
    places = running(tokens.select("row", "doc_id", "key", "n"), ["key", "doc_id", "row"], sums={"upto": "n"})
    placed = tokens.join(places.select("row", (F.col("upto") - F.col("n")).alias("before")).hint("merge"), "row")
    return pieces_of(placed, length, wide)


def packed_sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = PAD_ID) -> DataFrame:
    """The matrix of packed ids, a row for each sequence, with cumulative segment lengths and positions that begin at 0 in each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def rows(held: list[dict]) -> pa.RecordBatch:
            ids, place = np.full(length, pad_id, "<u4"), np.zeros(length, "<u4")
            for p in held:
                ids[p["offset"] : p["offset"] + p["length"]] = np.frombuffer(p["ids"], "<u4")
                place[p["offset"] : p["offset"] + p["length"]] = np.arange(p["length"])
            ends = [p["offset"] + p["length"] for p in held]
            return pa.RecordBatch.from_pydict(
                {"sequence_id": pa.array([held[0]["sequence_id"]], pa.int64()), "n_tokens": pa.array([ends[-1]], pa.int32()), "ids": pa.array([ids.tobytes()]),
                 "positions": pa.array([place.tobytes()]), "cu_seqlens": pa.array([[0, *ends]], pa.list_(pa.int32())),
                 "doc_ids": pa.array([[p["doc_id"] for p in held]], pa.list_(pa.int64())), "starts": pa.array([[p["start"] for p in held]], pa.list_(pa.int64()))}
            )

        for batch in batches:
            for piece in batch.to_pylist():
                if held and held[0]["sequence_id"] != piece["sequence_id"]:
                    yield rows(held)
                    held = []
                held.append(piece)
        if held:
            yield rows(held)

    return pieces.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(run, SEQUENCES)


def op12_curve_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents``, packed along a Hilbert curve into sequences of 2048 ids."""
    return pack_along_curve(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )

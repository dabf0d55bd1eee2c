"""Operator 5, packed token ids: best-fit-decreasing bins found in a segment tree.

Texts are tokenised with a public byte-level vocabulary, an end id after each.
A text longer than a sequence is cut into whole sequences and a rest, losing
nothing.  Pieces are packed in blocks of about BLOCK_IDS ids: by falling
length, each into the bin whose free room fits it most closely; a segment tree
over free room finds that bin in the logarithm of the sequence length.  Each
bin is a row: the ids as a row of a matrix (little-endian 32-bit, padded), the
cumulative lengths of its segments, and positions that begin at 0 in each
segment, with the ids and piece numbers of its texts.

Packing needs no shuffle: a block is a run of rows of one input partition, and
only its last bins are less than full.

A token never spans the place between a visible character and a white space
after it, so a text is tokenised by such units; a task encodes each distinct
unit once and remembers it.

Null texts are skipped, empty ones are an end id.  Repeated rows are packed
again.  A null id stays null.  Columns other than the two named ones are not
read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrays import SPACES, Block, blocks, ragged
from siftline.llm.frames import keyed_texts, table
from siftline.llm.units import Memo, per_text

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of the vocabulary's tokenizer, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
PAD_ID = 0
LENGTH = 2048
#: Ids packed together.
BLOCK_IDS = 1 << 21

PACKED = "task int, bin long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>"


class RoomTree:
    """A segment tree over the amounts of free room that holds how many bins have each."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._change(room, 1)

    def closest(self, need: int) -> int | None:
        """The smallest amount of free room of at least ``need`` that some bin has."""
        at = need + self.size
        if self.count[at]:
            return need
        # up to the first right-hand neighbour with a bin, then down its left side
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at *= 2
                    if not self.count[at]:
                        at += 1
                return at - self.size
            at >>= 1
        return None

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.bins[room].pop()


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """The bin of every piece, and the number of bins."""
    order = np.argsort(-sizes, kind="stable")
    tree, out, bins = RoomTree(length), np.empty(len(sizes), np.int64), 0
    for i, need in zip(order.tolist(), sizes[order].tolist(), strict=True):
        room = tree.closest(need)
        if room is None:
            bin_, room, bins = bins, length, bins + 1
        else:
            bin_ = tree.take(room)
        out[i] = bin_
        if room > need:
            tree.add(room - need, bin_)
    return out, bins


def unit_bounds(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of units: each begins at a white space after a character that is none in any script."""
    data = block.data
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    visible = (data > 0x20) & (data < 0x7F)
    # the second byte of a two-byte letter; 0xC2 and the three-byte leads also write white spaces
    visible[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    begins = np.zeros(len(data), bool)
    begins[1:] = space[data[1:]] & visible[:-1]
    heads = block.offsets[:-1][np.diff(block.offsets) > 0]
    begins[heads] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], len(data)), np.searchsorted(block.offsets, start, "right") - 1


class Tokenizer:
    """A byte-level vocabulary of ranks, with a memory of units."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})

        def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [encoding.encode_ordinary(u.decode()) for u in units]
            counts = np.array([len(x) for x in found], np.int64)
            return np.fromiter((i for x in found for i in x), np.int32, int(counts.sum())), counts

        self.memo = Memo(encode)

    def ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        start, end, owner = unit_bounds(block)
        ids, count = self.memo.ids_of(block, start, end)
        return ids, per_text(count, owner, len(block))


def packed_rows(ids: np.ndarray, counts: np.ndarray, names: pa.Array, length: int, task: int, first_bin: int) -> pa.RecordBatch:
    """The bins of a block of texts, whose ids stand one after the other."""
    chunks = np.maximum(-(-counts // length), 0)
    owner = np.repeat(np.arange(len(counts)), chunks)
    nth = ragged(np.zeros(len(counts), np.int64), chunks)
    begin = (np.cumsum(counts) - counts)[owner] + nth * length
    size = np.minimum(counts[owner] - nth * length, length)
    bin_, bins = best_fit(size, length)
    order = np.lexsort((nth, owner, bin_))
    owner, nth, begin, size, bin_ = owner[order], nth[order], begin[order], size[order], bin_[order]
    per_bin = np.bincount(bin_, minlength=bins)
    ends = np.cumsum(size)
    filled = np.bincount(bin_, size, bins).astype(np.int64)
    within = ends - size - (np.cumsum(filled) - filled)[bin_]
    matrix = np.full((bins, length), PAD_ID, "<i4")
    place = np.zeros((bins, length), "<i4")
    target = ragged(bin_ * length + within, size)
    matrix.reshape(-1)[target] = ids[ragged(begin, size)]
    place.reshape(-1)[target] = ragged(np.zeros(len(size), np.int64), size)
    bounds = np.concatenate(([0], np.cumsum(per_bin))).astype(np.int32)
    # a leading 0 and then each segment's end
    marks = np.zeros(len(size) + bins, np.int32)
    marks[np.arange(len(size)) + bin_ + 1] = within + size
    starts = (bounds + np.arange(bins + 1)).astype(np.int32)
    return pa.RecordBatch.from_pydict(
        {
            "task": pa.array(np.full(bins, task, np.int32)), "bin": pa.array(first_bin + np.arange(bins)), "n_tokens": pa.array(filled.astype(np.int32)),
            "ids": _rows(matrix), "positions": _rows(place),
            "cu_seqlens": pa.ListArray.from_arrays(pa.array(starts), pa.array(marks)),
            "doc_ids": pa.ListArray.from_arrays(pa.array(bounds), names.take(pa.array(owner))),
            "pieces": pa.ListArray.from_arrays(pa.array(bounds), pa.array(nth.astype(np.int32))),
        }
    )


def _rows(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * 4
    offsets = (np.arange(len(matrix) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])


def pack_tokens(
    docs: DataFrame, text: str = "text", key: str = "doc_id", ranks: str = RANKS, length: int = LENGTH, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """One row per packed sequence of ``length`` ids; see ``unpack_tokens`` for the way back."""
    with open(ranks, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task, first_bin = Tokenizer(shared.value), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[pa.Array] = []
        waiting = 0

        def emit() -> pa.RecordBatch:
            return packed_rows(np.concatenate(ids), np.concatenate(counts), pa.concat_arrays(names), length, task, first_bin)

        for batch in batches:
            for block in blocks(batch.column("text")):
                body, count = tokenizer.ids(block)
                # an end id behind each text
                ended = np.full(len(body) + len(count), end_id, np.int32)
                ended[np.arange(len(body)) + np.repeat(np.arange(len(count)), count)] = body
                ids.append(ended)
                counts.append(count + 1)
                names.append(batch.column("doc_id")[block.rows])
                waiting += len(ended)
                if waiting >= block_ids:
                    rows = emit()
                    first_bin += rows.num_rows
                    ids, counts, names, waiting = [], [], [], 0
                    for at in range(0, rows.num_rows, 256):
                        yield rows.slice(at, 256)
        if counts:
            yield emit()

    return keyed_texts(docs, text, key).filter("text IS NOT NULL").mapInArrow(run, PACKED)


def unpack_tokens(packed: DataFrame) -> DataFrame:
    """(doc_id, piece, ids) of every segment of packed rows; the inverse of packing, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, nth, ids = [], [], []
            for i in range(batch.num_rows):
                row = np.frombuffer(batch.column("ids")[i].as_buffer(), "<i4")
                bounds = batch.column("cu_seqlens")[i].as_py()
                names += batch.column("doc_ids")[i].as_py()
                nth += batch.column("pieces")[i].as_py()
                ids += [row[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(names, pa.int64()), "piece": pa.array(nth, pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32()))}
            )

    return packed.select("ids", "cu_seqlens", "doc_ids", "pieces").mapInArrow(run, "doc_id long, piece int, ids array<int>")


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files, one matrix row each, under the shared ``path``."""
    packed.withColumn("sha", F.sha2("ids", 256)).write.mode("errorifexists").parquet(path)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Packed id sequences of every text of ``documents``."""
    return pack_tokens(table(spark, sf_dir, "documents"))

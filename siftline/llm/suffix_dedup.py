"""Operator 8, exact substring dedup: a suffix sort that compares by prefix hashes.

Bytes covered by a string of ``window`` bytes that also starts in a document
of smaller id are removed.  Sorting all suffixes of a corpus would move it
many times over; only those sharing an anchor can share a window, so:

1. Each text is cut into segments (see ``winnow``), one for about every 14
   bytes.  A task already settles those it sees twice: equal segments of later
   documents go wholly, only the first document's stands for them.  A task
   sends its segments in lots, one for each bucket of anchors.
2. Segments meet by bucket.  Equal spans are settled in the same way.  What is
   left are the distinct spans around an anchor that several documents share,
   and of these such as also share what stands on one side of it, as two spans
   with an equal window do.  So common short strings, of which a larger corpus
   has ever more, leave nothing open.
3. Their bytes are fetched, and the suffixes that begin at each window are
   sorted by anchor and distance from it: a merge sort whose comparisons find
   the common extension by binary search over polynomial prefix hashes.
   Neighbours with a common prefix of ``window`` bytes are one string; their
   bytes are compared, so here a hash collision cannot remove anything.
4. Each document applies what was found.

Equal segments (1 and 2) are told by two 64-bit hashes, the segment's and its
anchor's, not by their bytes.  Segments of a hot passage
are one for each task and distinct surrounding, never one for each copy.  An
anchor with many distinct surroundings has its windows dealt out by their own
hash; of equal windows in a batch of texts again only the first travels on.
Tasks hold one bucket of 40-byte segments, one batch of texts, or some anchors
with their bytes.

Null and empty texts have no bytes and stay.  Rows with a null id are neither
removed from nor a reason to remove.  Rows that share an id are never a reason
to remove from each other.  Columns other than the two named ones are not
read, unless ``drop_repeats`` passes them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.arrays import Block, Prefix, blocks, bounds_of, byte_values, covered, mix, packed, ragged, unpacked
from siftline.llm.frames import by_group, in_slices, longs, per_batch, stored, table, whole_groups
from siftline.llm.suffixes import sorted_suffixes
from siftline.llm.winnow import SIDE_BITS, Segments, segments, side_length

WINDOW = 50
ANCHOR = 24
#: Segments a task gathers before it settles repeats among them.
FLUSH = 400_000
#: Bytes of texts or lots that a Python task takes at once.
BYTES_AT_ONCE = 8 << 20
#: Settled segments that travel together.
LOT = 1 << 11
#: Suffixes sorted at once.
SORTED_AT_ONCE = 200_000
#: Bytes of rows that a task of the suffix sort holds, or those of one anchor.
HELD_AT_ONCE = 8 << 20
#: Distinct spans around one anchor from which its windows are dealt out one by one.
WIDE = 2048

#: Bits of the sides of an anchor that several documents share.
LEFT, RIGHT = 1, 2

LOTS = "bucket int, settled boolean, data binary"
ROUTES = "doc_id long, version int, number int, open boolean, wide boolean, sides int"
CONTEXTS = "anchor long, doc_id long, version int, number int, nth int, lead int, context binary"
REMOVALS = "doc_id long, version int, number int, windows long"


def cut(block: Block, window: int, k: int) -> Segments:
    return segments(Prefix(byte_values(block.data)), block.offsets, window, k)


def _record(schema: str, **columns: np.ndarray) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [columns[n] if isinstance(columns[n], pa.Array) else longs(columns[n]) if t == "long" else pa.array(columns[n], types[t]) for n, t in names],
        names=[n for n, _ in names],
    )


def _place(version: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A text's version and a segment's number within it, as one value."""
    return (version.astype(np.int64) << 32) | number.astype(np.int64)


def segment_lots(rows: DataFrame, window: int, k: int, buckets: int) -> DataFrame:
    """The distinct segments of texts in lots, one for each task and bucket of anchors; repeats within a task are settled."""
    bits = np.uint64(65 - buckets.bit_length())

    def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        anchor, span, sides, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        by = np.lexsort((place, doc, span, anchor))
        anchor, span, doc, place = anchor[by], span[by], doc[by], place[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])
        again = ~fresh
        again[1:] &= (doc[1:] == doc[:-1]) & (place[1:] >> 32 == place[:-1] >> 32)
        settled = doc > doc[fresh][np.cumsum(fresh) - 1]
        # settled rows need no company: they are dealt out evenly
        done = np.flatnonzero(settled & ~again)
        if len(done):
            cuts = np.append(np.arange(0, len(done), LOT), len(done))
            dealt = mix(doc[done[cuts[:-1]]].view(np.uint64) + place[done[cuts[:-1]]].view(np.uint64)) >> bits
            yield from _lots((doc[done], place[done]), cuts, dealt, True)
        live = np.flatnonzero(~settled & ~again)
        if len(live):
            bucket = anchor[live] >> bits
            cuts = bounds_of(bucket)
            yield from _lots((anchor[live], span[live], sides[by[live]], doc[live], place[live]), cuts, bucket[cuts[:-1]], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            ids, versions = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
            for block in blocks(batch.column("text")):
                found = cut(block, window, k)
                at = block.rows.start + found.owner
                # an anchor is the smallest of many hashes, so its own highest bits are mostly zeros
                parts.append((mix(found.anchor), found.span, found.sides, ids[at], _place(versions[at], found.number)))
                waiting += len(at)
                if waiting >= FLUSH:
                    yield from settle(parts)
                    waiting = 0
        yield from settle(parts)

    return rows.select("doc_id", "version", "text").mapInArrow(run, LOTS)


def _lots(columns: tuple[np.ndarray, ...], cuts: np.ndarray, bucket: np.ndarray, settled: bool) -> Iterator[pa.RecordBatch]:
    """A row for the columns between each two cuts."""
    for at in range(0, len(cuts) - 1, 32):
        of = cuts[at : at + 33].tolist()
        data = [packed(np.stack([x[lo:hi].view(np.int64) for x in columns])) for lo, hi in zip(of[:-1], of[1:], strict=True)]
        yield _record(LOTS, bucket=bucket[at : at + 32].astype(np.int32), settled=np.full(len(data), settled), data=pa.array(data, pa.binary()))


def _several(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a key that rows of another document have too; a key of 0 is none."""
    by = np.argsort(keys, kind="stable")
    starts = bounds_of(keys[by])[:-1]
    mixed = np.maximum.reduceat(doc[by], starts) > np.minimum.reduceat(doc[by], starts)
    out = np.empty(len(keys), bool)
    out[by] = np.repeat(mixed, np.diff(np.append(starts, len(keys))))
    return out & (keys != 0)


def routed(lots: DataFrame, wide: int) -> DataFrame:
    """Settles equal spans of different documents; what shares only its anchor and what stands on one side of it stays open."""

    def route(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor, span, sides, doc, place = np.concatenate(found, axis=1)
        found.clear()
        by = np.lexsort((doc, span, anchor))
        anchor, span, sides, doc, place = anchor[by], span[by], sides[by].view(np.uint64), doc[by], place[by]
        new_anchor = np.ones(len(by), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_span = new_anchor.copy()
        new_span[1:] |= span[1:] != span[:-1]
        removed = doc > doc[new_span][np.cumsum(new_span) - 1]
        starts = np.flatnonzero(new_anchor)
        group = np.cumsum(new_anchor) - 1
        first = np.where(removed, np.iinfo(np.int64).min, doc)
        mixed = np.maximum.reduceat(first, starts) > np.minimum.reduceat(doc, starts)
        is_open = ~removed & mixed[group]
        at, shared = np.flatnonzero(is_open), np.zeros(len(by), np.int32)
        if len(at):
            own = mix(anchor[at].view(np.uint64))
            for bit, side in ((LEFT, sides[at] & np.uint64((1 << SIDE_BITS) - 1)), (RIGHT, sides[at] >> np.uint64(SIDE_BITS))):
                shared[at] |= np.where(_several(np.where(side > 0, mix(own + side), side), doc[at]), bit, 0)
            is_open = shared > 0
        spans = np.cumsum(new_span) - 1
        several = np.zeros(len(starts), np.int64)
        np.add.at(several, group[new_span][np.unique(spans[is_open])], 1)
        use = removed | is_open
        yield from in_slices(_routes(doc[use], place[use], is_open[use], (several >= wide)[group[use]], shared[use]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lots_ in by_group(batches, ["bucket"]):
            live = []
            for settled, data in zip(lots_.column("settled").to_pylist(), lots_.column("data").to_pylist(), strict=True):
                if settled:
                    doc, place = unpacked(data, 2)
                    none = np.zeros(len(doc), bool)
                    yield from in_slices(_routes(doc, place, none, none, none))
                else:
                    live.append(unpacked(data, 5))
            del lots_
            if live:
                yield from route(live)

    return lots.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ROUTES)


def _routes(doc: np.ndarray, place: np.ndarray, is_open: np.ndarray, wide: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
    number = (place & 0xFFFFFFFF).astype(np.int32)
    return _record(ROUTES, doc_id=doc, version=(place >> 32).astype(np.int32), number=number, open=is_open, wide=wide, sides=sides.astype(np.int32))


def _flat(column: pa.Array, block: Block) -> tuple[np.ndarray, pa.Array]:
    """Owner and flattened values of a list column for the texts of a block."""
    lists = column[block.rows]
    counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    return np.repeat(np.arange(len(block)), counts), lists.flatten()


def _settled_windows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Windows of wide anchors, each a row of its own; of equal ones in a batch only the first document's needs its bytes."""
    key, doc, version, number, nth, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((doc, key))
    key, doc, version, number, nth, data = key[by], doc[by], version[by], number[by], nth[by], data[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    settled = (doc > doc[head]) & (data == data[head]).all(axis=1)
    dealt = np.where(settled, mix(doc.view(np.uint64) + number.astype(np.uint64) * np.uint64(64) + nth.astype(np.uint64)), key)
    length = np.where(settled, 0, data.shape[1])
    offsets = np.zeros(len(by) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    bytes_ = pa.Array.from_buffers(pa.binary(), len(by), [None, pa.py_buffer(offsets), pa.py_buffer(data[~settled].tobytes())])
    return _record(CONTEXTS, anchor=dealt, doc_id=doc, version=version, number=number, nth=nth, lead=np.zeros(len(by), np.int32), context=bytes_)


def contexts(texts: DataFrame, window: int, k: int) -> DataFrame:
    """The bytes of every open segment, or of each of its windows where the anchor is wide.

    A window that its task has settled already has no bytes.
    """
    half = side_length(window, k)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, versions = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
        dealt: list[tuple[np.ndarray, ...]] = []
        for block in blocks(batch.column("text")):
            found = cut(block, window, k)
            owner, marks = _flat(batch.column("numbers"), block)
            first = np.searchsorted(found.owner, np.arange(len(block)))
            all_at, wide = first[owner] + marks.field("number").to_numpy(), marks.field("wide").to_numpy(zero_copy_only=False)
            at, rows = all_at[~wide], block.rows.start + owner[~wide]
            length = found.count[at] + window - 1
            offsets = np.zeros(len(at) + 1, np.int32)
            np.cumsum(length, out=offsets[1:])
            data = block.data[ragged(found.start[at], length)]
            bytes_ = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield from in_slices(
                _record(CONTEXTS, anchor=found.anchor[at], doc_id=ids[rows], version=versions[rows], number=found.number[at],
                        nth=np.zeros(len(at), np.int32), lead=found.lead[at], context=bytes_), 1 << 14
            )
            count = found.count[all_at[wide]]
            at, rows = np.repeat(all_at[wide], count), np.repeat(block.rows.start + owner[wide], count)
            nth = ragged(np.zeros(len(count), np.int64), count)
            # a window that others have too holds the whole of a side that others have too
            sides, before = np.repeat(marks.field("sides").to_numpy()[wide], count), found.lead[at] - nth
            some = ((sides & LEFT > 0) & (before >= half)) | ((sides & RIGHT > 0) & (window - k - before >= half))
            at, rows, nth = at[some], rows[some], nth[some]
            if len(at):
                start = found.start[at] + nth
                key = mix(Prefix(byte_values(block.data)).run(start, start + window))
                dealt.append((key, ids[rows], versions[rows], found.number[at].astype(np.int32), nth.astype(np.int32), block.data[start[:, None] + np.arange(window)]))
        if dealt:
            yield from in_slices(_settled_windows(dealt), 1 << 14)

    return texts.mapInArrow(per_batch(run), CONTEXTS)


def _repeated_windows(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which suffixes start with ``window`` bytes that also start in a smaller document."""
    prefix = Prefix(byte_values(data))
    order, common = sorted_suffixes(prefix, data, start, window, bucket)
    same = common >= window
    pairs = np.flatnonzero(same)
    for at in range(0, len(pairs), 20_000):  # the bytes decide, not the hashes
        part = pairs[at : at + 20_000]
        a, b = start[order[part - 1]], start[order[part]]
        reach = np.arange(window)
        same[part] = (data[a[:, None] + reach] == data[b[:, None] + reach]).all(axis=1)
    begin = np.flatnonzero(~same)
    least = np.minimum.reduceat(doc[order], begin)
    found = np.zeros(len(start), bool)
    found[order] = doc[order] > np.repeat(least, np.diff(np.append(begin, len(order))))
    return found


def sorted_out(rows: DataFrame, window: int) -> DataFrame:
    """For every open segment the windows to remove, as bits, from a suffix sort by anchor."""

    def sort(found: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor = found.column("anchor").to_numpy()
        empty = pa.compute.binary_length(found.column("context")).to_numpy() == 0
        names = ("doc_id", "version", "number", "nth", "lead")
        doc, version, number, shift, lead = (found.column(c).to_numpy() for c in names)
        bit = np.uint64(1) << shift.astype(np.uint64)
        yield from in_slices(_record(REMOVALS, doc_id=doc[empty], version=version[empty], number=number[empty], windows=bit[empty]))
        by = np.flatnonzero(~empty)
        by = by[np.argsort(anchor[by], kind="stable")]
        if not len(by):
            return
        anchor, doc, version, number, shift, lead = (x[by] for x in (anchor, doc, version, number, shift, lead))
        column = found.column("context").combine_chunks() if isinstance(found.column("context"), pa.ChunkedArray) else found.column("context")
        _, at, raw = column.buffers()
        offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        begin, length = offsets[:-1][by], np.diff(offsets)[by]
        data = np.frombuffer(raw, np.uint8)
        count = length - window + 1
        new = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        total = np.concatenate(([0], np.cumsum(count)))[new]
        lo = 0
        while lo < len(new) - 1:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SORTED_AT_ONCE, "right")) - 1)
            rows_ = slice(new[lo], new[hi])
            own = ragged(begin[rows_], length[rows_])
            local = np.concatenate(([0], np.cumsum(length[rows_])[:-1]))
            n = count[rows_]
            row = np.repeat(np.arange(len(n)), n)
            nth = ragged(np.zeros(len(n), np.int64), n)
            away = (lead[rows_][row] - nth).astype(np.uint64)
            bucket = mix(anchor[rows_].view(np.uint64)[row] + away * np.uint64(0x9FB21C651E98DF25))
            hit = _repeated_windows(data[own], local[row] + nth, bucket, doc[rows_][row], window)
            bits = np.zeros(len(n), np.uint64)
            np.bitwise_or.at(bits, row[hit], np.uint64(1) << nth[hit].astype(np.uint64))
            some = np.flatnonzero(bits)
            yield from in_slices(_record(REMOVALS, doc_id=doc[rows_][some], version=version[rows_][some], number=number[rows_][some], windows=bits[some] << shift[rows_][some].astype(np.uint64)))
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_groups(batches, "anchor", HELD_AT_ONCE):
            yield from sort(found)

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, REMOVALS)


def removed_bytes(block: Block, owner: np.ndarray, numbers: np.ndarray, windows: np.ndarray, window: int, k: int) -> np.ndarray:
    """Which bytes of a block go: the listed segments, and equal ones of the same text."""
    found = cut(block, window, k)
    if not len(numbers):
        return np.zeros(len(block.data), bool)
    key = mix(found.anchor + mix(found.span + found.owner.astype(np.uint64)))
    first = np.searchsorted(found.owner, np.arange(len(block)))
    marked = key[first[owner] + numbers]
    by = np.argsort(marked, kind="stable")
    marked, windows = marked[by], windows[by].view(np.uint64)
    begin = np.flatnonzero(np.append(True, marked[1:] != marked[:-1]))
    marked, windows = marked[begin], np.bitwise_or.reduceat(windows, begin)
    at = np.minimum(np.searchsorted(marked, key), len(marked) - 1)
    hit = np.flatnonzero(marked[at] == key)
    row = np.repeat(hit, found.count[hit])
    nth = ragged(np.zeros(len(hit), np.int64), found.count[hit])
    chosen = (windows[at[row]] >> nth.astype(np.uint64)) & np.uint64(1) == 1
    start = found.start[row[chosen]] + nth[chosen]
    return covered(start, start + window, len(block.data))


def repeats(rows: DataFrame, window: int, k: int, wide: int) -> DataFrame:
    """(doc_id, version, found): what to remove from each text that has any repeat."""
    if window - k + 1 > 63:
        raise ValueError("a segment may have 63 windows at most")
    # a task settles one bucket at a time: enough of them that partitions are even, not so many that lots are tiny
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << (max(256, min(16 * parts, 4096), 4 * parts) - 1).bit_length()
    routes = stored(routed(segment_lots(rows, window, k, buckets), wide), "routes", BYTES_AT_ONCE)
    opened = routes.filter("open").groupBy("doc_id", "version").agg(F.collect_list(F.struct("number", "wide", "sides")).alias("numbers"))
    wanted = stored(contexts(rows.join(opened.hint("merge"), ["doc_id", "version"]), window, k), "contexts")
    removals = stored(sorted_out(wanted, window), "removals")
    whole = routes.filter("NOT open").select("doc_id", "version", "number", F.lit(-1).cast("long").alias("windows"))
    return whole.union(removals).groupBy("doc_id", "version").agg(F.collect_list(F.struct("number", "windows")).alias("found"))


def applied(docs: DataFrame, text: str, key: str, window: int, k: int, wide: int, finish: Callable, schema: str | T.StructType, keep: list[str]) -> DataFrame:
    """``docs`` with their removals; ``finish`` turns a batch, a block and its removed bytes into result rows."""
    rows = docs.select(*(F.col(c).alias(f"own_{i}") for i, c in enumerate(keep)), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("version", F.shiftright(F.xxhash64("text"), 49).cast("int"))
    found = repeats(rows.filter("doc_id IS NOT NULL").select("doc_id", "version", "text"), window, k, wide)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column("text")):
            owner, marks = _flat(batch.column("found"), block)
            gone = removed_bytes(block, owner, marks.field("number").to_numpy(), marks.field("windows").to_numpy(), window, k)
            yield finish(batch, block, gone)

    return rows.join(found.hint("merge"), ["doc_id", "version"], "left").mapInArrow(per_batch(run), schema)


def repeat_report(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, k: int = ANCHOR, wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs``: bytes, removed bytes and runs, and the hash of what is kept."""

    def finish(batch: pa.RecordBatch, block: Block, gone: np.ndarray) -> pa.RecordBatch:
        total = np.concatenate(([0], np.cumsum(gone)))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edge = block.offsets[:-1][block.offsets[:-1] < len(gone)]
        begins[edge] = gone[edge]
        runs = np.concatenate(([0], np.cumsum(begins)))
        lo, hi = block.offsets[:-1], block.offsets[1:]
        digests = [hashlib.sha256(block.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(lo, hi, strict=True)]
        return pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id")[block.rows], "n_bytes": longs(hi - lo), "n_removed": longs(total[hi] - total[lo]),
             "n_spans": longs(runs[hi] - runs[lo]), "kept_sha256": pa.array(digests, pa.string())}
        )

    return applied(docs, text, key, window, k, wide, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", [])


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, k: int = ANCHOR, wide: int = WIDE) -> DataFrame:
    """``docs`` with repeats cut out of the texts; a character is cut only when all its bytes go."""
    columns = docs.columns
    others = [c for c in columns if c != text]
    fields = [docs.schema[c] if c != text else T.StructField(text, T.StringType()) for c in columns]

    def finish(batch: pa.RecordBatch, block: Block, gone: np.ndarray) -> pa.RecordBatch:
        lead = np.flatnonzero((block.data & 0xC0) != 0x80)
        if len(lead):
            whole = np.logical_and.reduceat(gone, lead)
            gone = np.repeat(whole, np.diff(np.append(lead, len(gone))))
        left = np.concatenate(([0], np.cumsum(~gone)))[block.offsets]
        kept = pa.LargeStringArray.from_buffers(len(block), pa.py_buffer(left.astype(np.int64)), pa.py_buffer(block.data[~gone])).cast(pa.string())
        if batch.column("text").null_count:
            kept = pa.compute.if_else(batch.column("text")[block.rows].is_valid(), kept, pa.scalar(None, pa.string()))
        by_name = {c: batch.column(f"own_{i}")[block.rows] for i, c in enumerate(others)} | {text: kept}
        return pa.RecordBatch.from_arrays([by_name[c] for c in columns], names=columns)

    return applied(docs, text, key, window, k, wide, finish, T.StructType(fields), others)


def op8_suffix_sort(spark, sf_dir: str) -> DataFrame:
    """What repeats of 50 bytes leave of every text of ``documents``."""
    return repeat_report(table(spark, sf_dir, "documents"))

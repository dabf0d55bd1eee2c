"""Operator 6, near-duplicates: an LSH forest over MinHash signatures.

A text is the set of its distinct word shingles.  Equal sets become one class
first, so groups of copies weigh as much as one text.  Each class has TREES
signatures of DEPTH minima.  Every tree is the table of classes sorted by its
signature; neighbours share the longest prefixes.  The depth adapts to the
region: a prefix of one or two minima makes candidates only where few classes
share it, denser regions are entered more deeply, and in each region a class
is paired with the one before it and with the region's smallest class.  That
is at most a few pairs for each class and tree, which link most of a group.

Candidates that a short sketch shows to be far apart go (five standard
deviations), and the best partner of each class is confirmed on the full sets;
star contraction makes components of the links.

What the neighbours leave apart is settled inside the regions: every region of
one shared minimum that still holds several components is dealt into cells of
bounded size, in which any two classes of different components meet once.  A
cell finds the classes whose sketches come close to another component, gets
their full sets, compares pairs exactly, the likeliest first, and merges
components as it goes; it returns only links that merged two, fewer than it
has classes.  So no table of pairs is ever made: all that is shuffled grows
with the number of classes, and a large group that is one component costs a
look at its labels.  Two sets of similarity 0.8 share no first minimum in any
tree in one case of 10^11, and miss the sketch's bound in one of 10^7.

Nothing is collected on the driver, and sorting by range splits the largest
regions over tasks.

Null and empty texts have no shingles, link with nothing and are kept.
Several texts under one id are linked through it.  Rows with a null id are
returned unlinked and kept.  Repeated rows get equal results.  Among equally
close partners the smallest id is tried first, and a component is named by its
smallest id.  Very long texts are read whole; their set is one value in a cell.
An empty table gives an empty result.  Columns other than the two named ones
are not read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrays import Block, Prefix, Words, blocks, mix, window_starts
from siftline.llm.components import components
from siftline.llm.frames import by_group, gathered, keyed_texts, longs, per_batch, stored, table

TREES = 16
DEPTH = 6
#: Regions of one and of two shared minima make candidates up to these sizes.
SPARSE = {1: 16, 2: 64}
#: Classes, and shingles of their sets, in a part of a region; two parts meet in a cell.
BLOCK = 1 << 12
SET_ITEMS = 1 << 22
#: Pairs looked at together within a cell.
PAIRS = 1 << 20
#: Of the sketch's bytes so many standard deviations below the threshold may agree.
SLACK = 5.5

_MULTIPLY = np.random.default_rng(611).integers(1, (1 << 63) - 1, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other, and their counts."""
    words = Words(block, lower=True)
    prefix = Prefix(words.hash)
    at = window_starts(words.first, size)
    key, owner = mix(prefix.run(at, at + size) + np.uint64(size)), words.doc()[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        whole = mix(prefix.run(words.first[short], words.first[short + 1]) + words.count[short].astype(np.uint64))
        key, owner = np.concatenate((key, whole)), np.concatenate((owner, short))
        by = np.argsort(owner, kind="stable")
        key, owner = key[by], owner[by]
    tagged = mix(key + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    by = np.argsort(tagged)
    first = np.ones(len(by), bool)
    first[1:] = tagged[by][1:] != tagged[by][:-1]
    keep = np.zeros(len(by), bool)
    keep[by[first]] = True
    return key[keep], np.bincount(owner[keep], minlength=len(block))


def set_hashes(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set of shingles, 0 for an empty one."""
    filled = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[filled]
    sums = np.zeros((2, len(count)), np.uint64)
    if len(filled):
        sums[0, filled] = np.add.reduceat(mix(key + np.uint64(1)), start)
        sums[1, filled] = np.add.reduceat(mix(key ^ np.uint64(0x1234567)), start)
    return sums[0], sums[1]


def signatures(block: Block, size: int) -> dict[str, np.ndarray]:
    """Set size, 128-bit set hash and signature of each text."""
    key, count = shingle_sets(block, size)
    filled = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[filled]
    minima = np.zeros((len(block), TREES * DEPTH), np.uint32)
    if len(filled):
        for k, factor in enumerate(_MULTIPLY):
            minima[filled, k] = np.minimum.reduceat((key * factor) >> np.uint64(32), start)
    low, high = set_hashes(key, count)
    return {"n": count, "low": low, "high": high, "minima": minima}


def _bytes_column(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    data = np.ascontiguousarray(matrix)
    width = data.dtype.itemsize * data.shape[1]
    offsets = np.arange(len(data) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """Binary values of one width as the rows of a matrix."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype)


def signature_table(docs: DataFrame, size: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column("text")):
            found = signatures(block, size)
            minima = found["minima"]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")[block.rows], "n_shingles": longs(found["n"]), "low": longs(found["low"]), "high": longs(found["high"]),
                 "paths": _bytes_column(minima.astype(">u4")), "sketch": _bytes_column(minima.astype(np.uint8))}
            )

    return docs.mapInArrow(per_batch(run), "doc_id long, n_shingles long, low long, high long, paths binary, sketch binary")


def region_pairs(paths: np.ndarray, ids: np.ndarray, same_tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among sorted paths: each class with the one before it and with its region's smallest class."""
    n = len(ids)
    common = np.zeros(n, np.int64)
    alike = same_tree[1:].copy()
    for d in range(paths.shape[1]):
        alike &= paths[1:, d] == paths[:-1, d]
        common[1:] += alike
    pairs = []
    for d in range(1, paths.shape[1] + 1):
        start = np.flatnonzero(common < d)
        size = np.diff(np.append(start, n))
        usable = (size > 1) & (size <= SPARSE.get(d, n))
        if not usable.any():
            continue
        leader = np.minimum.reduceat(ids, start)
        inside = np.repeat(usable, size)
        pairs.append((np.repeat(leader, size)[inside], ids[inside]))
        linked = inside.copy()
        linked[start] = False
        at = np.flatnonzero(linked)
        pairs.append((ids[at - 1], ids[at]))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    found = np.unique(np.stack((a[a != b], b[a != b]), axis=1), axis=0)
    return found[:, 0], found[:, 1]


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """(a, b, votes): pairs of classes that some tree holds close, and in how many trees."""
    width = DEPTH * 4
    trees = classes.select(
        "rep", F.posexplode(F.expr(f"transform(sequence(0, {TREES - 1}), i -> substring(paths, i * {width} + 1, {width}))")).alias("tree", "path")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches)
        if rows is None:
            return
        tree = rows.column("tree").to_numpy()
        same = np.ones(len(tree), bool)
        same[1:] = tree[1:] == tree[:-1]
        a, b = region_pairs(_matrix(rows.column("path").combine_chunks(), ">u4"), rows.column("rep").to_numpy(), same)
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_pydict({"a": longs(a[at : at + 100_000]), "b": longs(b[at : at + 100_000])})

    found = trees.repartitionByRange("tree", "path").sortWithinPartitions("tree", "path", "rep").mapInArrow(run, "a long, b long")
    return found.groupBy("a", "b").agg(F.count("*").alias("votes"))


def least_equal(threshold: float) -> int:
    """Bytes of two sketches that agree at least, unless the sets are less alike than ``threshold``."""
    bytes_ = TREES * DEPTH
    return int(bytes_ * threshold - SLACK * (bytes_ * threshold * (1 - threshold)) ** 0.5)


def close_pairs(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sketches do not rule out ``threshold``."""
    least = least_equal(threshold)
    both = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(
        sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b"
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        equal = (_matrix(batch.column("sa"), "u1") == _matrix(batch.column("sb"), "u1")).sum(axis=1)
        keep = pa.array(equal >= least)
        yield pa.RecordBatch.from_pydict(
            {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep), "close": pa.array(equal[equal >= least].astype(np.int64))}
        )

    return both.select("a", "b", "sa", "sb").mapInArrow(per_batch(run), "a long, b long, close long")


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold: 100 * intersection >= per_cent * union."""
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("hb")), "b").join(
        sets.select(F.col("rep").alias("a"), F.col("shingles").alias("ha")), "a"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                merged = np.sort(np.concatenate((x, y)))
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * common >= per_cent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)})

    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def apart_pairs(heads: np.ndarray, sketch: np.ndarray, size: np.ndarray, component: Callable[[], np.ndarray], left: np.ndarray, right: np.ndarray,
                tree: int, per_cent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a row of ``left`` and one of ``right`` in different components that sizes and sketches do not rule out, some rows at a time.

    ``component`` is asked anew for every part, so pairs joined meanwhile are
    left out.  A pair that shares several regions comes out in the first of
    their trees only.
    """
    least, same = least_equal(per_cent / 100), left is right
    step = max(1, PAIRS // max(1, len(right)))
    for lo in range(0, len(left), step):
        x, now = left[lo : lo + step], component()
        may = now[x][:, None] != now[right][None, :]
        small, large = np.minimum(size[x][:, None], size[right][None, :]), np.maximum(size[x][:, None], size[right][None, :])
        may &= 100 * small >= per_cent * large
        if same:
            may &= np.arange(lo, lo + len(x))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(may)
        i, j = x[i], right[j]
        first = np.concatenate([(heads[i[at : at + PAIRS // 8]] == heads[j[at : at + PAIRS // 8]]).argmax(axis=1) == tree for at in range(0, len(i), PAIRS // 8)] or [np.zeros(0, bool)])
        i, j = i[first], j[first]
        equal = np.concatenate([(sketch[i[at : at + PAIRS // 8]] == sketch[j[at : at + PAIRS // 8]]).sum(axis=1) for at in range(0, len(i), PAIRS // 8)] or [np.zeros(0, np.int64)])
        keep = equal >= least
        yield i[keep], j[keep], equal[keep]


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j) of sorted sets, exactly: products of 0-1 matrices over the shared shingles."""
    out = np.zeros(len(i), np.int64)
    if len(i) < 64:
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            merged = np.sort(np.concatenate((sets[a], sets[b])))
            out[k] = (merged[1:] == merged[:-1]).sum()
        return out
    x, at_x = np.unique(i, return_inverse=True)
    y, at_y = np.unique(j, return_inverse=True)
    row_x, row_y = (np.repeat(np.arange(len(r)), [len(sets[k]) for k in r]) for r in (x, y))
    all_x, all_y = (np.concatenate([sets[k] for k in r]) for r in (x, y))
    shared = np.intersect1d(all_x, all_y)
    width = max(1, (1 << 24) // (len(x) + len(y)))
    col_x, col_y = (np.minimum(np.searchsorted(shared, v), max(0, len(shared) - 1)) for v in (all_x, all_y))
    for lo in range(0, len(shared), width):
        part = shared[lo : lo + width]
        ones = []
        for rows, col, values, n in ((row_x, col_x, all_x, len(x)), (row_y, col_y, all_y, len(y))):
            here = (col >= lo) & (col < lo + len(part)) & (shared[col] == values)
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[rows[here], col[here] - lo] = 1
            ones.append(matrix)
        out += (ones[0] @ ones[1].T)[at_x, at_y].astype(np.int64)
    return out


class Union:
    """Components of a cell: labels that merge."""

    def __init__(self, component: np.ndarray):
        self.names, self.label = np.unique(component, return_inverse=True)
        self.parent = np.arange(len(self.names))

    def now(self) -> np.ndarray:
        while not (self.parent == (up := self.parent[self.parent])).all():
            self.parent = up
        return self.parent[self.label]

    def join(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Merges the components of the pairs; the links that merged two."""
        roots, links = self.now(), []
        for a, b in np.unique(np.stack((roots[i], roots[j]), axis=1), axis=0).tolist():
            x, y = a, b
            while self.parent[x] != x:
                x = int(self.parent[x])
            while self.parent[y] != y:
                y = int(self.parent[y])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                links.append((int(self.names[a]), int(self.names[b])))
        return links


CELL = ["tree", "head", "x", "y"]


def cells(members: DataFrame) -> DataFrame:
    """Deals the regions of one shared minimum that hold several components into cells of bounded size.

    Two members of different components meet in some cell.  A region's largest
    component does not meet itself, so its members are in as many cells as the
    other components fill parts, mostly one.
    """
    heads = F.expr(f"transform(sequence(0, {TREES - 1}), i -> substring(heads, i * 4 + 1, 4))")
    regions = members.select("rep", "low", "high", "component", "n_shingles", F.posexplode(heads).alias("tree", "head"))
    per = regions.groupBy("tree", "head", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    mixed = per.groupBy("tree", "head").agg(
        F.max(F.struct("n", "s", "component")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("several")
    ).filter("several > 1")
    fill = "cast(ceil(greatest({n} / %d, {s} / %d)) as int)" % (BLOCK, SET_ITEMS)
    small = f"n <= {BLOCK} AND s <= {SET_ITEMS}"
    mixed = mixed.select(
        "tree", "head", F.col("main.component").alias("main"),
        F.expr(f"if({small}, 1, {fill.format(n='(n - main.n)', s='(s - main.s)')})").alias("others"),
        F.expr(f"if({small}, 0, {fill.format(n='main.n', s='main.s')})").alias("own"),
    )
    part = "if(component = main AND own > 0, others + cast(pmod(xxhash64(rep), own) as int), cast(pmod(xxhash64(rep), others) as int))"
    dealt = regions.join(mixed, ["tree", "head"]).withColumn("part", F.expr(part)).withColumn(
        "other", F.explode(F.expr("sequence(0, if(part < others, others + own, others) - 1)"))
    )
    return dealt.select("rep", "low", "high", "tree", "head", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))


class Cell:
    """The members of one cell as arrays."""

    def __init__(self, rows: pa.Table):
        self.tree, self.x, self.y = (rows.column(c)[0].as_py() for c in ("tree", "x", "y"))
        self.component, self.size, part = (rows.column(c).to_numpy() for c in ("component", "n_shingles", "part"))
        self.heads, self.sketch = _matrix(rows.column("heads"), ">u4"), _matrix(rows.column("sketch"), "u1")
        self.left = np.flatnonzero(part == self.x)
        self.right = self.left if self.x == self.y else np.flatnonzero(part == self.y)

    def pairs(self, component: Callable[[], np.ndarray], per_cent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return apart_pairs(self.heads, self.sketch, self.size, component, self.left, self.right, self.tree, per_cent)


def near_members(met: DataFrame, per_cent: int) -> DataFrame:
    """The members of cells whose sketch is close to that of a member of another component; at most the rows given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, CELL):
            cell = Cell(rows)
            near = np.zeros(rows.num_rows, bool)
            for i, j, _ in cell.pairs(lambda cell=cell: cell.component, per_cent):
                near[i] = near[j] = True
            if near.any():
                yield from rows.select(["rep", "low", "high", "tree", "head", "part", "x", "y"]).filter(pa.array(near)).combine_chunks().to_batches()

    return met.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "rep long, low long, high long, tree int, head binary, part int, x int, y int")


def joined_components(met: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): links between components that some pair of full sets in a cell makes; fewer than a cell has members.

    A cell keeps the components that its links have merged, so a pair is
    compared only while it would still merge two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, CELL):
            cell = Cell(rows)
            sets = [np.sort(np.frombuffer(x.as_buffer(), np.uint64)) for x in rows.column("shingles")]
            union, links = Union(cell.component), []
            for i, j, close in cell.pairs(union.now, per_cent):
                # the closest first; what they merge need not be compared again
                order = np.argsort(-close, kind="stable")
                for at in range(0, len(order), PAIRS // 8):
                    some = order[at : at + PAIRS // 8]
                    now = union.now()
                    some = some[now[i[some]] != now[j[some]]]
                    if len(some):
                        a, b = i[some], j[some]
                        common = intersections(sets, a, b)
                        equal = 100 * common >= per_cent * (cell.size[a] + cell.size[b] - common)
                        links += union.join(a[equal], b[equal])
            if links:
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return met.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "a long, b long")


def set_table(docs: DataFrame, size: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column("text")):
            key, count = shingle_sets(block, size)
            low, high = set_hashes(key, count)
            offsets = np.zeros(len(count) + 1, np.int32)
            np.cumsum(count * 8, out=offsets[1:])
            sets = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(key.tobytes())])
            yield pa.RecordBatch.from_pydict({"rep": batch.column("rep")[block.rows], "low": longs(low), "high": longs(high), "shingles": sets})

    return docs.mapInArrow(per_batch(run), "rep long, low long, high long, shingles binary")


def still_apart(placed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], per_cent: int) -> DataFrame:
    """(a, b): links between components of ``placed`` (rep, low, high, component, n_shingles, paths, sketch) that full sets make."""
    width = DEPTH * 4
    heads = F.concat(*(F.substring("paths", i * width + 1, 4) for i in range(TREES))).alias("heads")
    members = placed.select("rep", "low", "high", "component", "n_shingles", "sketch", heads)
    near = stored(near_members(cells(members).join(members, ["rep", "low", "high"]), per_cent), "near")
    met = near.join(members, ["rep", "low", "high"]).join(sets_of(near.select("rep")).hint("merge"), ["rep", "low", "high"])
    return stored(joined_components(met, per_cent), "joined")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per row of ``docs``: set size, component (its smallest id) and whether it is the one kept."""
    rows = keyed_texts(docs, text, key)
    signed = stored(signature_table(rows, shingle), "signatures")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    named = usable.groupBy("low", "high").agg(F.min("doc_id").alias("rep"))
    reps = stored(named.join(usable.withColumnRenamed("doc_id", "rep"), ["rep", "low", "high"]).dropDuplicates(["rep", "low", "high"]), "classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = rows.join(wanted.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
        texts = texts.withColumn("same", F.xxhash64("text")).dropDuplicates(["doc_id", "same"])
        return set_table(texts.select(F.col("doc_id").alias("rep"), "text"), shingle).dropDuplicates(["rep", "low", "high"])

    pairs = close_pairs(candidate_pairs(reps), reps.select("rep", "sketch"), per_cent / 100)
    best = stored(pairs.groupBy("b").agg(F.max_by("a", F.struct("close", -F.col("a"))).alias("a")), "pairs")
    sets = stored(sets_of(best.select(F.explode(F.array("a", "b")).alias("rep"))).select("rep", "shingles"), "sets")
    # several texts under one id are linked through it
    shared = usable.groupBy("doc_id").agg(F.count_distinct("low", "high").alias("texts")).filter("texts > 1").select("doc_id")
    through = usable.join(shared, "doc_id").join(named, ["low", "high"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    first = components(confirmed(best, sets, per_cent).union(through)).withColumnRenamed("node", "rep")
    placed = stored(reps.join(first, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")

    merged = components(still_apart(placed, sets_of, per_cent)).select(F.col("node").alias("component"), F.col("component").alias("into"))
    classes = placed.select("low", "high", "component").distinct().join(merged, "component", "left").groupBy("low", "high").agg(
        F.min(F.coalesce("into", "component")).alias("component"), F.lit(True).alias("some")
    )
    out = signed.select("doc_id", "n_shingles", "low", "high").join(classes, ["low", "high"], "left")
    component = F.when(F.col("some") & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def op6_lsh_forest(spark, sf_dir: str) -> DataFrame:
    """Components of ``documents`` linked by four-word shingles at a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)

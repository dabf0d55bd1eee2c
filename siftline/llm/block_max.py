"""Operator 11, ranked lexical search: an inverted index in shards, searched with Block-Max MaxScore.

Index.  Consecutive texts of about SHARD_BYTES make a shard.  For each of its
terms a row holds the postings (text number and frequency) in blocks of BLOCK,
each block as variable-length bytes that decode on their own, with the last
text of each block and the pairs (frequency, text length) that no other posting
of the block dominates.  A posting's score grows with its frequency and falls
with the length of its text, so these few pairs give a block's exact largest
score under any corpus statistics, without its postings.  Indexing is one
narrow pass; every text is indexed whole.

Search.  Corpus counts and the frequencies of the queries' terms are sums over
index rows.  The rows of those terms are brought together by shard, and a task
searches its shards one after the other, with one heap for each item:

* Lists are ordered by their bounds (weight times largest block score).  The
  strongest lists give first texts; scored in full they raise the threshold.
* The weakest lists whose bounds together stay below the threshold are not
  essential: a text found only there cannot enter the heap.  Essential lists
  are decoded whole.
* A candidate's score so far plus the block maxima of the other lists must
  reach the threshold, else it is rejected before any block is decompressed.
  For the others, list by list, only the blocks that hold a candidate are
  decoded, and candidates fall out as soon as what is left cannot lift them.

Each task returns its heaps, and Spark's group limit merges them.  All bounds
are inclusive, so no tie is lost, and results equal those of scoring all texts.

Items are read in blocks of ITEM_BYTES of text (one longer item counts as a
block), so what is broadcast is bounded; each block of items reads the index
once.  A shard is bounded by its bytes, so no group is.

A null text has no terms; texts and items without terms rank nowhere.  Rows with
a null id are left out.  Repeated rows are ranked one by one, and rows of one
item id each get an answer.  Equal scores go by ascending id.  An empty table
gives an empty result.  Very long texts are a shard of their own.  Columns
other than the named ones are not read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.arrays import IS_ALNUM, Block, Words, blocks, ragged
from siftline.llm.frames import by_group, in_slices, keyed_texts, longs, stored, table

#: Text in a shard, postings in a block, and text of the items searched at once.
SHARD_BYTES = 8 << 20
BLOCK = 64
ITEM_BYTES = 1 << 20
TOP = 10

INDEX = "shard long, term string, df long, occurrences long, blocks binary, peaks binary, postings binary"
FOUND = "item int, doc_id long, score long"


def encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits to a byte, low bits first, the top bit set in all but the last byte; and where each value ends."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[ends[some] - size[some] + k] = ((values[some] >> (7 * k)) & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, ends


def decoded(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    start = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    size = ends - start + 1
    out = (raw[start] & 127).astype(np.int64)
    for k in range(1, int(size.max(initial=1))):
        some = np.flatnonzero(size > k)
        out[some] |= (raw[start[some] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of an array that end at ``ends`` as binary values."""
    offsets = np.concatenate(([0], ends)) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def shard_rows(block: Block, ids: pa.Array, shard: int) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard: its texts (no term), then each term."""
    words = Words(block, lower=True, inside=IS_ALNUM, hashes=False)
    texts, n = len(block), words.count.astype(np.int64)
    yield pa.RecordBatch.from_pydict(
        {"shard": longs(np.array([shard])), "term": pa.array([None], pa.string()), "df": longs(np.array([int((n > 0).sum())])), "occurrences": longs(np.array([int(n.sum())])),
         "blocks": pa.array([ids.to_numpy().astype("<i8").tobytes()], pa.binary()), "peaks": pa.array([n.astype("<i4").tobytes()], pa.binary()), "postings": pa.array([None], pa.binary())}
    )
    if not len(words.start):
        return
    number = words.ids()
    both = np.sort(number * texts + words.doc())
    start = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    tf, term, doc = np.diff(np.append(start, len(both))), both[start] // texts, both[start] % texts
    head = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    df = np.diff(np.append(head, len(term)))
    within = np.arange(len(term)) - np.repeat(head, df)
    opens = within % BLOCK == 0
    gap = np.where(opens, doc, doc - np.append(0, doc[:-1]))
    data, ends = encoded(np.stack((gap, tf), axis=1).reshape(-1))
    ends = ends[1::2]
    block_of = np.cumsum(opens) - 1
    last = np.append(np.flatnonzero(opens)[1:], len(term)) - 1
    # pairs of a block by falling frequency; one that is not longer than all before it is dominated by none
    by = np.lexsort((n[doc], -tf, block_of))
    falling = n[doc][by] + (block_of[-1] - block_of[by]) * (int(n.max()) + 1)
    peak = by[np.append(True, falling[1:] < np.minimum.accumulate(falling)[:-1])]
    peaks = np.bincount(block_of[peak], minlength=len(last))
    term_end = head + df
    term_bytes = ends[term_end - 1]
    first_byte = np.concatenate(([0], term_bytes[:-1]))
    of_block = term[last]
    blocks_end = np.cumsum(np.bincount(of_block, minlength=len(head)))
    table_ = np.stack((doc[last], ends[last] - first_byte[of_block], peaks), axis=1).astype("<i4")
    any_place = np.empty(len(head), np.int64)
    any_place[number] = np.arange(len(number))
    size = words.end[any_place] - words.start[any_place]
    names = pa.LargeStringArray.from_buffers(
        len(head), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(words.data[ragged(words.start[any_place], size)].tobytes())
    ).cast(pa.string())
    yield from in_slices(pa.RecordBatch.from_pydict(
        {"shard": longs(np.full(len(head), shard)), "term": names, "df": longs(df), "occurrences": longs(np.add.reduceat(tf, head)),
         "blocks": _binary(table_.reshape(-1), blocks_end * 3), "peaks": _binary(np.stack((tf[peak], n[doc[peak]]), axis=1).astype("<i4").reshape(-1), np.cumsum(peaks)[blocks_end - 1] * 2),
         "postings": _binary(data, term_bytes)}
    ))


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The inverted index of ``docs``, written once: one row for each shard and term, and one without a term for each shard.

    Shards are numbered by input task, so all reads must see the same table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in blocks(batch.column("text"), shard_bytes, 1 << 17):
                yield from shard_rows(block, batch.column("doc_id")[block.rows], shard)
                shard += 1

    return stored(keyed_texts(docs, text, key).filter("doc_id IS NOT NULL").mapInArrow(run, INDEX), "index")


class Statistics:
    """Numbers of texts with terms and of term occurrences, and the score parts that follow."""

    def __init__(self, texts: int, occurrences: int):
        self.texts, self.occurrences = texts, occurrences

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.texts + 2) / (2 * df + 1)))

    def part(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * n * self.texts) // self.occurrences
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Postings:
    """One term's list in a shard; blocks are decoded when they are needed."""

    def __init__(self, df: int, blocks_: bytes, peaks: bytes, data: bytes, n: np.ndarray, statistics: Statistics):
        rows = np.frombuffer(blocks_, "<i4").reshape(-1, 3).astype(np.int64)
        pairs = np.frombuffer(peaks, "<i4").reshape(-1, 2).astype(np.int64)
        self.last, self.end, self.data, self.df = rows[:, 0], rows[:, 1], np.frombuffer(data, np.uint8), df
        self.peak = np.maximum.reduceat(statistics.part(pairs[:, 0], pairs[:, 1]), np.cumsum(rows[:, 2]) - rows[:, 2])
        self.best, self.n, self.statistics = int(self.peak.max()), n, statistics
        self.whole: tuple[np.ndarray, np.ndarray] | None = None
        self.opened = np.zeros(len(self.end), bool)

    def read(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and score parts of the postings of some blocks, ascending."""
        self.opened[which] = True
        begin = np.where(which > 0, self.end[which - 1], 0)
        values = decoded(self.data if len(which) == len(self.end) else self.data[ragged(begin, self.end[which] - begin)])
        gap, tf = values[0::2], values[1::2]
        size = np.where(which == len(self.end) - 1, self.df - BLOCK * (len(self.end) - 1), BLOCK)
        heads = np.cumsum(size) - size
        doc = np.cumsum(gap)
        doc -= np.repeat(doc[heads] - gap[heads], size)
        return doc, self.statistics.part(tf, self.n[doc])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            self.whole = self.read(np.arange(len(self.end)))
        return self.whole

    def bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block in which each text would stand, and that block's largest part (0 behind the last block)."""
        at = np.searchsorted(self.last, docs)
        inside = at < len(self.last)
        return at, np.where(inside, self.peak[np.minimum(at, len(self.last) - 1)], 0)

    def parts(self, docs: np.ndarray) -> np.ndarray:
        """The score part of each of the ascending texts; 0 where the term is absent."""
        if self.whole is None:
            at = np.searchsorted(self.last, docs)
            which = np.unique(at[at < len(self.last)])
            found, part = self.read(which) if 2 * len(which) < len(self.last) else self.all()
        else:
            found, part = self.whole
        if not len(found):
            return np.zeros(len(docs), np.int64)
        at = np.minimum(np.searchsorted(found, docs), len(found) - 1)
        return np.where(found[at] == docs, part[at], 0)


def _least(scores: np.ndarray, k: int) -> int:
    """The k-th highest of positive scores, or 0 if there are fewer."""
    return max(0, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else 0


def best_texts(lists: list[tuple[Postings, int]], texts: int, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a shard, ascending, with scores that may be among the k highest and reach ``least``: Block-Max MaxScore."""
    lists = sorted(((p, w) for p, w in lists if w > 0), key=lambda x: -x[0].best * x[1])
    none = np.zeros(0, np.int64)
    rest = np.append(np.cumsum([p.best * w for p, w in lists][::-1])[::-1], 0) if lists else np.zeros(1, np.int64)
    if not lists or rest[0] < least:
        return none, none
    score, used, threshold = np.zeros(texts, np.int64), 0, least
    # the strongest lists give first texts, which are scored in full to raise the threshold
    while used < len(lists) and rest[used] >= threshold:
        postings, weight = lists[used]
        doc, part = postings.all()
        score[doc] += weight * part
        used += 1
        if int(np.count_nonzero(score)) >= k:
            break
    seen = np.flatnonzero(score)
    if len(seen) >= k:
        first = np.sort(seen[np.argpartition(score[seen], len(seen) - k)[len(seen) - k :]])
        full = score[first]
        for postings, weight in lists[used:]:
            full = full + weight * postings.parts(first)
        threshold = max(threshold, _least(full, k))
    # essential lists: the others together stay below the threshold
    while used < len(lists) and rest[used] >= threshold:
        postings, weight = lists[used]
        doc, part = postings.all()
        score[doc] += weight * part
        used += 1
    docs = np.flatnonzero(score)
    score = score[docs]
    threshold = max(threshold, _least(score, k))
    near = score + rest[used] >= threshold
    docs, score = docs[near], score[near]
    # block maxima of the other lists bound what a text may still gain
    bounds = [weight * postings.bounds(docs)[1] for postings, weight in lists[used:]]
    possible = score + sum(bounds) if bounds else score
    near = possible >= threshold
    docs, possible, bounds = docs[near], possible[near], [b[near] for b in bounds]
    for j, (postings, weight) in enumerate(lists[used:]):
        if not len(docs):
            break
        gain, bound = np.zeros(len(docs), np.int64), bounds[j]
        some = np.flatnonzero(bound)
        if len(some):
            gain[some] = weight * postings.parts(docs[some])
        possible = possible - bound + gain
        near = possible >= threshold
        docs, possible, bounds = docs[near], possible[near], [b[near] for b in bounds]
    keep = possible >= max(1, _least(possible, k))
    return docs[keep], possible[keep]


class Heaps:
    """The best texts so far of every item."""

    def __init__(self, items: int, k: int):
        none = np.zeros(0, np.int64)
        self.k, self.best = k, [(none, none)] * items

    def least(self, item: int) -> int:
        return int(self.best[item][1][-1]) if len(self.best[item][1]) >= self.k else 0

    def add(self, item: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.append(self.best[item][0], ids), np.append(self.best[item][1], score)
        by = np.lexsort((ids, -score))[: self.k]
        self.best[item] = ids[by], score[by]


def search_shard(rows: pa.Table, items: list[list[tuple[str, int]]], statistics: Statistics, heaps: Heaps) -> int:
    """Adds one shard's texts to the heaps; returns how many blocks were decompressed for it."""
    lists: dict[str, Postings] = {}
    names = rows.column("term").to_pylist()
    head = names.index(None)
    ids = np.frombuffer(rows.column("blocks")[head].as_buffer(), "<i8")
    n = np.frombuffer(rows.column("peaks")[head].as_buffer(), "<i4").astype(np.int64)
    for i, name in enumerate(names):
        if name is not None:
            lists[name] = Postings(rows.column("df")[i].as_py(), *(rows.column(c)[i].as_buffer() for c in ("blocks", "peaks", "postings")), n, statistics)
    for item, terms in enumerate(items):
        docs, score = best_texts([(lists[t], w) for t, w in terms if t in lists], len(n), heaps.k, heaps.least(item))
        if len(docs):
            heaps.add(item, ids[docs], score)
    return sum(int(p.opened.sum()) for p in lists.values())


def item_terms(text: str | None) -> list[str]:
    """The distinct terms of an item."""
    found: dict[str, None] = {}
    for block in blocks(pa.array([text], pa.string())):
        words = Words(block, lower=True, inside=IS_ALNUM, hashes=False)
        data = words.data.tobytes()
        found |= dict.fromkeys(data[a:b].decode() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True))
    return list(found)


def item_blocks(items: DataFrame, text: str, key: str, limit: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Ids and terms of the items, in blocks of bounded size, one at a time on the driver."""
    held, size = [], 0
    for row in items.select(F.col(key).cast("long"), F.col(text).cast("string")).filter(F.col(key).isNotNull()).toLocalIterator():
        held.append((row[0], item_terms(row[1])))
        size += len(row[1] or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(index: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", key: str = "item_id", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k best texts of an index for every item: item_id, rank, doc_id, score."""
    spark = index.sparkSession
    sums = index.filter("term IS NULL").agg(F.sum("df"), F.sum("occurrences")).first()
    statistics = Statistics(sums[0] or 0, sums[1] or 0)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for held in item_blocks(items, text, key, item_bytes) if statistics.texts else []:
        # at most the terms of one block of items
        terms = F.broadcast(spark.createDataFrame([(t,) for t in dict.fromkeys(t for _, terms in held for t in terms)], "term string"))
        df = {r["term"]: r["df"] for r in index.filter("term IS NOT NULL").join(terms, "term").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
        weighed = [[(t, statistics.weight(df[t])) for t in found if t in df] for _, found in held]
        shared = spark.sparkContext.broadcast((weighed, statistics))
        numbers = F.broadcast(spark.createDataFrame([(i, name) for i, (name, _) in enumerate(held)], "item int, item_id long"))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weighed, statistics = shared.value
            heaps = Heaps(len(weighed), k)
            for rows in by_group(batches, ["shard"]):
                search_shard(rows, weighed, statistics, heaps)
            sizes = np.array([len(x) for x, _ in heaps.best], np.int64)
            yield pa.RecordBatch.from_pydict(
                {"item": pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)),
                 "doc_id": longs(np.concatenate([x for x, _ in heaps.best])), "score": longs(np.concatenate([x for _, x in heaps.best]))}
            )

        rows = index.filter("term IS NOT NULL").join(terms, "term").select(index.columns).union(index.filter("term IS NULL"))
        found = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = out.union(ranked.join(numbers, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_block_max(spark, sf_dir: str) -> DataFrame:
    """The ten best ``documents`` for every ``benchmark`` item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH texts AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
counts AS (SELECT count(*) FILTER (len(terms) > 0) AS big_n, sum(len(terms))::BIGINT AS big_l FROM texts),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, counts GROUP BY term, big_n
),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term), counts GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""

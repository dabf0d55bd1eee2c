"""Operator 13, periodic runs: a sparse diagonal dynamic programme over the words of a text.

The cell (i, q) of the programme holds how many words up to word i equal the
words q before them.  Only cells where a word has an earlier occurrence at
distance q are ever made; along a diagonal q the lengths of active cells grow,
and a diagonal that ends with at least q matches (and ``min_length`` words in
all) gives the run of its words at once.

* Small lags are compared word by word.
* A larger lag q of [2s, 4s) matches at least q words on end or gives no run, so
  every s-th word meets it: at these words the earlier occurrences are those of
  the s words that start there, and an active diagonal grows by s words at a
  time.  Where it begins and ends between two such words is found with half the
  stride, a quarter, and so on.  A stride has at most 2s occurrences in its range
  of lags, so n words cost n cells for each doubling of the lag, whatever the
  text; a word repeated 300 000 times is no exception.
* Texts in which no stretch of s words occurs twice leave before the next stride.

A run that a shorter period explains appears on several diagonals with the
same ends; its smallest lag is its period.

Words are numbered by their bytes, which are compared; no hash decides.  One
narrow pass: no shuffle, and memory for a block of whole texts (about 80 bytes a
byte of the longest text for each of its strides with a repeat).

Null and empty texts have no words and no runs.  Very long texts are processed
whole.  Equally long runs are all returned, by start and then period.
Repeated rows and a null id get results row by row.  An empty table gives an
empty result.  Columns other than the two named ones are not read, so extra
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrays import Block, Words, blocks, covered, ragged
from siftline.llm.frames import keyed_texts, longs, per_batch, table

#: A run has at least this many words, and twice its period.
MIN_LENGTH = 12
#: Lags below this are compared word by word.
SMALL = 8

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of the pairs (high, low), and rank * n + position in ascending order."""
    n = len(high)
    bits = max(1, int(max(n, high.max(initial=0) + 1, low.max(initial=0) + 1)).bit_length())
    key = (high << bits) | low
    if 3 * bits <= 63:
        both = np.sort((key << bits) | np.arange(n))
        order, key = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    fresh = np.zeros(n, np.int64)
    fresh[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(fresh, out=fresh)
    return rank, fresh * n + order


def cells(rank: np.ndarray, places: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Every stride-th position, and its earlier occurrences at lags of [2, 4) strides: (position, lag)."""
    n = len(rank)
    at = np.arange(stride, n, stride)
    own = rank[at] * n
    lo = np.searchsorted(places, own + np.maximum(at - 4 * stride + 1, 0))
    hi = np.searchsorted(places, own + np.maximum(at - 2 * stride + 1, 0))
    count = np.maximum(hi - lo, 0)
    found = np.repeat(at, count)
    return found, found - (places[ragged(lo, count)] - np.repeat(own, count))


def diagonals(ranks: list[np.ndarray], at: np.ndarray, lag: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 matching position, and lag, of the diagonals through the cells; ``ranks[b]`` numbers the stretches of 2^b words."""
    n = len(ranks[0])
    if not len(at):
        return at, at, lag
    both = np.sort(lag * n + at)
    lag, at = both // n, both % n
    ended = np.append(both[1:] - both[:-1] != stride, True)
    begun = np.append(True, ended[:-1])
    lag, first, last = lag[begun], at[begun], at[ended] + stride
    step = stride >> 1
    while step:
        r = ranks[step.bit_length() - 1]
        before = first - step
        known = before - lag >= 0
        known[known] = r[before[known]] == r[(before - lag)[known]]
        first = np.where(known, before, first)
        place = np.minimum(last, n - 1)
        last = np.where((last < n) & (r[place] == r[place - lag]), last + step, last)
        step >>= 1
    return first, last, lag


def runs_of(words: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH) -> dict[str, np.ndarray]:
    """All runs of every text: ``words`` numbers the words of texts that begin at ``first``.  Sorted by text, start and period."""
    texts = len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    # a mark behind each text that equals no word, so that no diagonal of a run crosses it
    total = len(words) + texts
    symbols = np.empty(total, np.int64)
    place = np.arange(len(words)) + owner
    symbols[place] = words
    symbols[first[1:] + np.arange(texts)] = int(words.max(initial=-1)) + 1 + np.arange(texts)
    begins = first[:-1] + np.arange(texts)
    text_of = np.repeat(np.arange(texts), np.diff(first) + 1)

    starts, ends, lags = [], [], []

    def emit(lo: np.ndarray, hi: np.ndarray, lag: np.ndarray) -> None:
        long = hi - lo >= np.maximum(lag, min_length - lag)
        starts.append((lo - lag)[long])
        ends.append(hi[long])
        lags.append(lag[long])

    for q in range(1, min(SMALL, total)):
        same = np.zeros(total - q + 2, np.int8)
        same[1:-1] = symbols[q:] == symbols[:-q]
        edge = np.diff(same)
        lo = np.flatnonzero(edge == 1)
        emit(lo + q, np.flatnonzero(edge == -1) + q, np.full(len(lo), q))

    ranks, here, length = [symbols], np.arange(total), np.diff(first)
    stride = 1
    while len(here):
        rank = ranks[-1]
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-stride] = rank[stride:] + 1
        rank, places = ranked(rank, ahead)
        stride *= 2
        ranks.append(rank)
        if 2 * stride < SMALL:
            continue
        # only texts in which some stretch occurs twice, and that can hold two periods, go on
        n = len(rank)
        at, own = places % n, places // n
        again = np.flatnonzero((own[1:] == own[:-1]) & (text_of[at[1:]] == text_of[at[:-1]]))
        alive = np.zeros(texts, bool)
        alive[text_of[at[again]]] = True
        alive &= length >= 4 * stride
        keep = alive[text_of]
        if not keep.all():
            ranks, here, text_of = [r[keep] for r in ranks], here[keep], text_of[keep]
            at = (np.cumsum(keep) - 1)[at[keep[at]]]
            places = ranks[-1][at] * len(here) + at
        if len(here):
            lo, hi, lag = diagonals(ranks, *cells(ranks[-1], places, stride), stride)
            # such a diagonal lies within one text, and texts stay whole in ``here``
            long = hi - lo >= lag
            emit(here[lo[long]], here[hi[long] - 1] + 1, lag[long])
    lo, hi, lag = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, lags))
    order = np.argsort(lag, kind="stable")
    _, one = np.unique(lo[order] * (total + 1) + hi[order], return_index=True)
    lo, hi, lag = lo[order[one]], hi[order[one]], lag[order[one]]
    text = np.searchsorted(begins, lo, "right") - 1
    order = np.lexsort((lag, lo))
    return {"text": text[order], "start": (lo - begins[text])[order], "length": (hi - lo)[order], "period": lag[order]}


def spaced(block: Block, words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    at = np.flatnonzero(keep)
    size = words.end[at] - words.start[at]
    ends = np.cumsum(size + 1)
    joined = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    joined[ragged(ends - size - 1, size)] = block.data[ragged(words.start[at], size)]
    total = np.concatenate(([0], np.cumsum(keep)))
    bounds = np.concatenate(([0], ends))[total[words.first]]
    text = joined.tobytes()
    return pa.array([text[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per row of ``docs``: its words, all its periodic runs, and the text with every run cut to its first period."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column("text")):
            words = Words(block, hashes=False)
            found = runs_of(words.ids(), words.first, min_length)
            begin = words.first[found["text"]] + found["start"]
            gone = covered(begin + found["period"], begin + found["length"], len(words.start))
            bounds = np.searchsorted(found["text"], np.arange(len(block) + 1))
            runs = pa.StructArray.from_arrays([longs(found[c]) for c in ("start", "length", "period")], ["start", "length", "period"])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")[block.rows], "n_words": longs(words.count),
                 "runs": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs), "collapsed": spaced(block, words, ~gone)}
            )

    return keyed_texts(docs, text, key).mapInArrow(per_batch(run), SCHEMA)


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` in which every text whose id has a crc32 divisible by 10 repeats a stretch of its words from some word on."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, 0L)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(sequence(0L, n - 1L), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every text of ``documents``, of which a tenth are made periodic, and digests of the runs and of what is left without them."""
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

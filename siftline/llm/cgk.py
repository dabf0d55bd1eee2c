"""Operator 3, benchmark decontamination: edit distance by random walks, LSH and exact verification.

A CGK walk reads a word sequence x and writes one word a step: at step t it
writes x[i] and moves on by a random bit that depends on t and on x[i].  Two
sequences of small edit distance meet again soon after each edit, so what they
write differs in few places (Hamming distance).  Bit-sampling LSH picks SAMPLES
steps of a walk; equal words there make a window a candidate for an item.
TABLES independent walks and samples are tried for each class of item sizes.

Walks alone lose matches when a fifth of the words is edited.  An item that
may have k edits is therefore also cut into k + 1 pieces: k edits leave one of
them whole, so a lookup of all pieces at every word misses no match.

Windows start at every word of every text, so an item is met at its own
alignment.  A window leaves a table as soon as a sample fits no item; most
leave at the first.  Candidates around which too few words are the item's go
(k edits leave all words but k).  What remains is verified by the exact edit distance of
the item to the best stretch of the text around the window.

Items are read in blocks of ITEMS_AT_ONCE items and ITEM_CHARS characters, which
bounds the broadcast; each block is one narrow pass over the texts.  Words are runs of letters and digits,
A-Z lower-cased.

Null and empty texts match nothing, nor do items without words.  Items of one to
four words allow no edit and are found verbatim.  Very long texts are read
whole; of equally near places the first counts.  Empty tables give an empty
result.  Repeated rows give repeated results.  Columns other than those named are not read,
except that ``decontaminated`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrays import IS_ALNUM, Block, Words, blocks, mix, ragged
from siftline.llm.frames import keyed_texts, longs, per_batch, table

TABLES = 12
SAMPLES = 4
#: Share of an item's words that may be edited.
EDITS = 0.2
#: Items of fewer words are not looked for.
MIN_WORDS = 1
#: Items, and characters of their texts, that are looked for at once.
ITEMS_AT_ONCE = 1 << 15
ITEM_CHARS = 1 << 23

MATCHES = "doc_id long, item_id long, item_words long, first_word long, distance long"


class Table:
    """One walk with its samples, and the keys that items of one size class reach after each sample."""

    def __init__(self, items: list[np.ndarray], numbers: np.ndarray, least: int, rng: np.random.Generator):
        steps = max(2, least * 5 // 4)
        self.turn, self.shift = int(rng.integers(0, 32)) * 2 + 1, int(rng.integers(0, 64))
        times = np.sort(rng.choice(steps, min(SAMPLES, steps), replace=False))
        # an early first sample lets most windows leave after a step or two
        times = np.unique(np.append(times, rng.integers(0, 2)))[: max(SAMPLES, 1)]
        self.times = times.tolist()
        symbols = np.concatenate(items)
        first = np.concatenate(([0], np.cumsum([len(x) for x in items])))
        end = first[1:]
        at, key, alive = first[:-1].copy(), np.zeros(len(items), np.uint64), np.ones(len(items), bool)
        bits = mix(symbols)
        self.keys = []
        for t in range(self.times[-1] + 1):
            alive &= at < end
            now = np.minimum(at, len(symbols) - 1)
            if t in self.times:
                key = mix(key * np.uint64(0x9FB21C651E98DF25) + symbols[now])
                self.keys.append(np.unique(key[alive]))
            at = at + self.moves(bits[now], t)
        by = np.argsort(key[alive], kind="stable")
        self.last_keys, self.items = key[alive][by], numbers[alive][by]
        self.door = np.zeros(1 << 16, bool)
        self.door[(self.keys[0] & np.uint64(0xFFFF)).astype(np.int64)] = True

    def moves(self, bits: np.ndarray, t: int) -> np.ndarray:
        return ((bits >> np.uint64((t * self.turn + self.shift) & 63)) & np.uint64(1)).astype(np.int64)

    def candidates(self, symbols: np.ndarray, bits: np.ndarray, doors: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (by their first word) and the items whose samples they share.

        ``bits`` are the words' walk bits and ``doors`` their lowest 16: the
        first sample is read from them for all windows at once.
        """
        if self.times[0] == 0:
            window = np.flatnonzero(self.door[doors])
            at = window
        else:
            at = np.arange(len(symbols) - 1) + self.moves(bits[:-1], 0)
            window = np.flatnonzero(self.door[doors[at]])
            at = at[window]
        key = bits[at]
        for depth, t in enumerate(self.times):
            if depth:
                for step in range(self.times[depth - 1], t):
                    at = at + self.moves(bits[at], step)
                    inside = at < end[window]
                    window, at, key = window[inside], at[inside], key[inside]
                key = mix(key * np.uint64(0x9FB21C651E98DF25) + symbols[at])
            known = self.keys[depth]
            if not len(known):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            inside = at < end[window]
            inside &= known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            window, at, key = window[inside], at[inside], key[inside]
        lo, hi = np.searchsorted(self.last_keys, key, "left"), np.searchsorted(self.last_keys, key, "right")
        count = hi - lo
        return np.repeat(window, count), self.items[ragged(lo, count)]


def edit_distances(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Edit distance of ``item`` to the best stretch of each row of ``texts`` (0 is no word)."""
    return edit_rows(item, texts).min(axis=1)


def edit_rows(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Edit distance of ``item`` to the best stretch of each row of ``texts`` that ends before each place."""
    width = texts.shape[1]
    along = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((len(texts), width + 1), np.int32)
    for symbol in item:
        step = np.empty_like(row)
        step[:, 0] = row[:, 0] + 1
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts != symbol))
        row = np.minimum.accumulate(step - along, axis=1) + along
    return row


class Pieces:
    """Pieces of one length, cut from items so that the allowed edits cannot touch all pieces of an item."""

    def __init__(self, length: int, symbols: list[np.ndarray], item: list[int], offset: list[int]):
        self.length = length
        key = self.run(np.concatenate(symbols))[::length]
        by = np.argsort(key, kind="stable")
        self.keys, self.item, self.offset = key[by], np.array(item, np.int64)[by], np.array(offset, np.int64)[by]
        self.door = np.zeros(1 << 20, bool)
        self.door[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def run(self, symbols: np.ndarray) -> np.ndarray:
        """A key of the ``length`` symbols from each place on."""
        n = len(symbols) - self.length + 1
        key = np.zeros(max(n, 0), np.uint64)
        for i in range(self.length if n > 0 else 0):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + symbols[i : i + n])
        return key

    def candidates(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words at which items would start whose pieces the texts hold (the text's first word at the earliest), and these items."""
        key = self.run(symbols)
        at = np.flatnonzero(self.door[(key & np.uint64(0xFFFFF)).astype(np.int64)])
        at = at[at + self.length <= end[at]]
        lo, hi = np.searchsorted(self.keys, key[at], "left"), np.searchsorted(self.keys, key[at], "right")
        piece = ragged(lo, hi - lo)
        at = np.repeat(at, hi - lo)
        return np.maximum(at - self.offset[piece], begin[at]), self.item[piece]


class Items:
    """A block of benchmark items and the tables of their size classes."""

    def __init__(self, ids: list[int], texts: list[str | None], min_words: int, edits: float, seed: int = 3):
        self.ids, self.symbols = [], []
        for block in blocks(pa.array(texts, pa.string())):
            words = Words(block, lower=True, inside=IS_ALNUM)
            for i, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                if hi - lo >= min_words:
                    self.ids.append(ids[block.rows.start + i])
                    self.symbols.append(words.hash[lo:hi] | np.uint64(1))
        sizes = np.array([len(x) for x in self.symbols], np.int64)
        self.limit = np.floor(sizes * edits).astype(np.int64)
        rng, self.tables = np.random.default_rng(seed), []
        classes = np.floor(np.log2(np.maximum(sizes, 1)) * 2).astype(int)
        for c in np.unique(classes):
            members = np.flatnonzero(classes == c)
            # items that allow no edit are found by their own words (see ``Pieces``)
            for _ in range(TABLES if self.limit[members].any() else 0):
                self.tables.append(Table([self.symbols[i] for i in members], members, int(sizes[members].min()), rng))

        cut: dict[int, tuple[list, list, list]] = {}
        for i, x in enumerate(self.symbols):
            parts = max(1, min(int(self.limit[i]) + 1, len(x)))
            bounds = np.arange(parts + 1) * len(x) // parts
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                symbols, item, offset = cut.setdefault(hi - lo, ([], [], []))
                symbols.append(x[lo:hi])
                item.append(i)
                offset.append(lo)
        self.pieces = [Pieces(length, *cut[length]) for length in sorted(cut)]
        self.sizes = sizes
        owner = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
        self.held = np.unique(mix(np.concatenate(self.symbols) + owner * np.uint64(0xD6E8FEB86659FD93))) if self.symbols else np.zeros(0, np.uint64)

    def likely(self, pairs: np.ndarray, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The (item, window) pairs around whose window enough words are words of the item."""
        keep = np.zeros(len(pairs), bool)
        size = self.sizes[pairs[:, 0]]
        for m in np.unique(size):
            rows = np.flatnonzero(size == m)
            k = int(self.limit[pairs[rows[0], 0]])
            reach = np.arange(-k, m + k)
            step = max(1, (1 << 20) // len(reach))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                item, start = pairs[part, 0], pairs[part, 1]
                places = start[:, None] + reach
                inside = (places >= begin[start][:, None]) & (places < end[start][:, None])
                key = mix(symbols[np.clip(places, 0, len(symbols) - 1)] + item.astype(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93))
                known = self.held[np.minimum(np.searchsorted(self.held, key), len(self.held) - 1)] == key
                keep[part] = (known & inside).sum(axis=1) >= m - k
        return pairs[keep]

    def matches(self, block: Block) -> dict[str, np.ndarray]:
        """The best match of every item in every text of the block."""
        words = Words(block, lower=True, inside=IS_ALNUM)
        symbols = words.hash | np.uint64(1)
        out: list[tuple[int, int, int, int]] = []
        if len(symbols) and self.pieces:
            bits, end, doc = mix(symbols), np.repeat(words.first[1:], words.count), words.doc()
            doors = (bits & np.uint64(0xFFFF)).astype(np.int64)
            begin = np.repeat(words.first[:-1], words.count)
            found = [t.candidates(symbols, bits, doors, end) for t in self.tables]
            found += [p.candidates(symbols, begin, end) for p in self.pieces]
            window, item = (np.concatenate(x) for x in zip(*found, strict=True))
            both = np.unique(item * len(symbols) + window)
            pairs = self.likely(np.stack((both // len(symbols), both % len(symbols)), axis=1), symbols, begin, end)
            bounds = np.append(np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0])), len(pairs)) if len(pairs) else [0]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                i = int(pairs[lo, 0])
                k, best = int(self.limit[i]), {}
                reach = np.arange(-k, len(self.symbols[i]) + k)
                for part in range(lo, hi, 2000):
                    starts = pairs[part : min(hi, part + 2000), 1]
                    places = starts[:, None] + reach
                    inside = (places >= words.first[doc[starts]][:, None]) & (places < end[starts][:, None])
                    texts = np.where(inside, symbols[np.clip(places, 0, len(symbols) - 1)], np.uint64(0))
                    distance = edit_distances(self.symbols[i], texts)
                    for w, d in zip(starts[distance <= k].tolist(), distance[distance <= k].tolist(), strict=True):
                        best[int(doc[w])] = min(best.get(int(doc[w]), (d, w)), (d, w))
                for j, (d, w) in best.items():
                    # the stretch may start up to k words off the window: the reversed item tells where
                    left, right = max(w - k, int(words.first[j])), min(w + len(self.symbols[i]) + k, int(end[w]))
                    back = edit_rows(self.symbols[i][::-1], symbols[left:right][::-1][None, :])[0]
                    out.append((j, i, right - int(back.argmin()) - int(words.first[j]), d))
        found = np.array(sorted(out), np.int64).reshape(-1, 4)
        return {"text": found[:, 0], "item": found[:, 1], "first_word": found[:, 2], "distance": found[:, 3]}


def item_blocks(benchmark: DataFrame, text: str, key: str, size: int, min_words: int, edits: float) -> Iterator[Items]:
    """The items in blocks of bounded size, one at a time on the driver."""
    ids, texts, chars = [], [], 0
    for row in benchmark.select(F.col(key).cast("long"), F.col(text).cast("string")).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        chars += len(row[1] or "")
        if len(ids) == size or chars >= ITEM_CHARS:
            yield Items(ids, texts, min_words, edits)
            ids, texts, chars = [], [], 0
    if ids:
        yield Items(ids, texts, min_words, edits)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
    edits: float = EDITS, min_words: int = MIN_WORDS, items_at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """One row for each text and each item found in it: place and edit distance of the best match, in words."""
    rows, spark = keyed_texts(docs, text, key), docs.sparkSession
    out = spark.createDataFrame([], MATCHES)
    for items in item_blocks(benchmark, item_text, item_key, items_at_once, min_words, edits):
        shared = spark.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            ids = batch.column("doc_id")
            names = pa.array(items.ids, pa.int64())
            for block in blocks(batch.column("text")):
                found = items.matches(block)
                sizes = np.array([len(x) for x in items.symbols], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": ids[block.rows].take(longs(found["text"])), "item_id": names.take(longs(found["item"])), "item_words": longs(sizes[found["item"]]),
                     "first_word": longs(found["first_word"]), "distance": longs(found["distance"])}
                )

        out = out.union(rows.mapInArrow(per_batch(run), MATCHES))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id",
                   edits: float = EDITS, min_words: int = MIN_WORDS, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; a narrow pass for each block of items."""
    for items in item_blocks(benchmark, item_text, item_key, items_at_once, min_words, edits):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batch.column(text)):
                clean = np.ones(len(block), bool)
                clean[shared.value.matches(block)["text"]] = False
                yield batch.slice(block.rows.start, len(block)).filter(pa.array(clean))

        docs = docs.mapInArrow(per_batch(run), docs.schema)
    return docs


def op3_cgk_lsh(spark, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` found in ``documents`` with at most a fifth of their words edited."""
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

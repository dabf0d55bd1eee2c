"""Operator 10, quality rules: how much of a text repeats itself, from a suffix array over its words.

Each text's words are sorted as suffixes; the common prefixes of neighbours
form intervals, and the deepest interval that holds a suffix is the longest
run of words that starts there and once more elsewhere.  Runs of at least
``min_repeat`` words are the maximal repeats; the union of their places must
not cover more than ``max_covered`` of the words, and none may be longer than
``max_repeat`` words.

One narrow pass over the table: no shuffle, and memory for one block of texts.

Words and lines are numbered by their bytes.  Null and empty texts have no
words and fail.  Equally long repeats all count.  Repeated rows are judged one by
one and get equal results.  Columns other than the two named ones are not
read.  An empty table gives an empty result.  Memory follows the longest
single text (about 60 bytes a byte of it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.arrays import IS_WORD, Block, Words, blocks, covered, span_ids
from siftline.llm.frames import keyed_texts, longs, per_batch, table
from siftline.llm.suffixes import repeat_lengths

#: Runs of this many words that occur twice count as repeats.
MIN_REPEAT = 4
#: The largest share of words that may lie in repeats.
MAX_COVERED = 0.5
#: The longest repeat, in words, that a text may hold.
MAX_REPEAT = 100
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def _sums(per_byte: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(per_byte) + 1, np.int64)
    np.cumsum(per_byte, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(block: Block, is_word: np.ndarray) -> np.ndarray:
    """For each text, the lines with a word that equal an earlier line of it."""
    data, offsets = block.data, block.offsets
    breaks = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    end = np.sort(np.concatenate((breaks, offsets[1:])))
    # a break splits its text in two, so the n-th start and the n-th end belong to one line
    owner = np.searchsorted(offsets, start, "right") - 1
    ends_text = np.searchsorted(offsets[1:], end, "left")
    owner = np.minimum(owner, ends_text)
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(is_word, out=words[1:])
    with_word = words[end] > words[start]
    start, end, owner = start[with_word], end[with_word], owner[with_word]
    key = span_ids(data, start, end)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[again], minlength=len(block))


def judge(block: Block, min_repeat: int, max_covered: float, max_repeat: int) -> dict[str, np.ndarray]:
    """All counts and the verdict for the texts of one block."""
    words = Words(block, hashes=False)
    doc, n_words, total = words.doc(), words.count.astype(np.int64), len(words.start)
    is_word = IS_WORD[block.data]
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    longest = repeat_lengths(words.ids().astype(np.uint64), doc)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=len(block)).astype(np.int64)

    at = np.flatnonzero(longest >= 3)
    triple = per_text(covered(at, at + 3, total))
    at = np.flatnonzero(longest >= min_repeat)
    spanned = per_text(covered(at, at + longest[at], total))
    deepest = np.zeros(len(block), np.int64)
    np.maximum.at(deepest, doc, longest)
    base_failed = (n_words < 50) | (100 * triple > 50 * n_words)
    over = (spanned > max_covered * n_words) | (deepest > max_repeat)
    return {
        "n_words": n_words,
        "word_chars": _sums(is_word & ((block.data & 0xC0) != 0x80), block.offsets),
        "n_symbols": _sums(symbols[block.data], block.offsets),
        "n_dup_lines": duplicate_lines(block, is_word),
        "n_repeat_words": triple,
        "covered_words": spanned,
        "longest_repeat": deepest,
        "base_failed": base_failed,
        "kept": ~base_failed & ~over,
    }


def repetition_rules(
    docs: DataFrame, text: str = "text", key: str = "doc_id",
    min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """One row per row of ``docs`` with its counts, covered words, longest repeat and verdict."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            found = judge(block, min_repeat, max_covered, max_repeat)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids[block.rows]} | {k: pa.array(v) if v.dtype == bool else longs(v) for k, v in found.items()}
            )

    return keyed_texts(docs, text, key).mapInArrow(per_batch(run), SCHEMA)


def drop_repetitive(docs: DataFrame, text: str = "text", **limits: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; one narrow pass."""
    limits = {"min_repeat": MIN_REPEAT, "max_covered": MAX_COVERED, "max_repeat": MAX_REPEAT} | limits

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column(text)):
            yield batch.slice(block.rows.start, len(block)).filter(pa.array(judge(block, **limits)["kept"]))

    return docs.mapInArrow(per_batch(run), docs.schema)


def op10_suffix_repetition(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every whole text of ``documents``."""
    return repetition_rules(table(spark, sf_dir, "documents"))

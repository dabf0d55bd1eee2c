"""Cuts texts into segments that any two equal windows share, for finding repeats without a row per window.

The anchor of a window is its k-gram of smallest hash (the leftmost of
equals); consecutive windows with one anchor form a segment.  Two equal
windows have equal anchors at equal distances, so they lie in segments with
one anchor hash, and comparing segments with equal anchors finds every
repeat.  A text has about one segment for every (window - k) / 2 symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from siftline.llm.arrays import Prefix, mix, sliding_min, window_starts

#: Bits of a position within a block; the same for all blocks, so that ties are broken alike everywhere.
_PLACE = np.uint64((1 << 28) - 1)


#: Bits of the hash of each side.
SIDE_BITS = 24


def _some(x: np.ndarray) -> np.ndarray:
    """SIDE_BITS of a hash, never 0."""
    return np.maximum(mix(x) >> np.uint64(64 - SIDE_BITS), np.uint64(1))


@dataclass
class Segments:
    """Anchor hash, span hash, sides (see ``segments``), first window, number of windows, the anchor's distance from it, text and number within the text."""

    anchor: np.ndarray
    span: np.ndarray
    sides: np.ndarray
    start: np.ndarray
    count: np.ndarray
    lead: np.ndarray
    owner: np.ndarray
    number: np.ndarray


def side_length(window: int, k: int) -> int:
    """Symbols on the longer side of an anchor within a window, at least."""
    return (window - k + 1) // 2


def segments(prefix: Prefix, first: np.ndarray, window: int, k: int) -> Segments:
    """All segments of the texts whose symbols begin at ``first``.

    ``sides`` holds what stands next to the anchor: SIDE_BITS of the hash of as
    many symbols on its left as make half of a window with it, above these those
    on its right, 0 where the span ends before.  Of two spans that share a
    window one side is the same.
    """
    at = window_starts(first, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Segments(*[none.astype(np.uint64)] * 3, *[none] * 5)
    grams = mix(prefix.windows(k))
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(keyed, window - k + 1)[at] & _PLACE).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    begin = np.flatnonzero(fresh)
    start, count, anchor = at[begin], np.diff(np.append(begin, len(at))), anchor[begin]
    owner = np.searchsorted(first, start, "right") - 1
    # the span's hash also holds where the anchor stands in it
    span = mix(prefix.run(start, start + count + window - 1) + (anchor - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64))
    number = np.arange(len(start)) - np.searchsorted(owner, np.arange(len(first) - 1))[owner]
    half = side_length(window, k)
    after = np.minimum(anchor + k + half, len(prefix.sums) - 1)
    left = np.where(anchor - start >= half, _some(prefix.run(np.maximum(anchor - half, 0), anchor)), np.uint64(0))
    right = np.where(anchor + k + half <= start + count + window - 1, _some(prefix.run(anchor + k, after)), np.uint64(0))
    return Segments(grams[anchor], span, left | (right << np.uint64(SIDE_BITS)), start, count, anchor - start, owner, number)

"""Suffix arrays of many short sequences at once, with common extensions found from prefix hashes."""

from __future__ import annotations

import numpy as np

from siftline.llm.arrays import Prefix, RunHash, mix


def common_prefix(prefix: Prefix | RunHash, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of the runs at ``a`` and ``b``, at most ``limit``.

    Doubling finds a range, binary search the length; each step compares two
    hashes of the prefix sums.  Pairs that differ early leave early.
    """
    low = np.zeros(len(a), np.int64)
    high = limit.astype(np.int64).copy()
    active = np.flatnonzero(high > 0)
    size = 1
    while len(active):
        tried = np.minimum(size, high[active])
        same = prefix.run(a[active], a[active] + tried) == prefix.run(b[active], b[active] + tried)
        low[active[same]] = tried[same]
        high[active[~same]] = tried[~same] - 1
        active = active[same & (tried < high[active])]
        size *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active] + 1) >> 1
        start_a, start_b, known = a[active], b[active], low[active]
        same = prefix.run(start_a + known, start_a + middle) == prefix.run(start_b + known, start_b + middle)
        low[active[same]] = middle[same]
        high[active[~same]] = middle[~same] - 1
        active = active[low[active] < high[active]]
    return low


def suffix_array(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of every sequence in sorted order, by doubling; suffixes of different owners never mix.

    Returns the order and, for every slot, whether it starts with another
    symbol or owner than the slot before.  Only groups that are still tied are
    sorted again.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    keys = mix(symbols + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    first_fresh = fresh.copy()
    starts = np.flatnonzero(fresh)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    rank[n] = -1
    end = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, n)
    end_of = np.repeat(end, np.diff(np.append(0, end)))
    width = 1
    tied = ~(fresh & np.append(fresh[1:], True))
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        beyond = at + width
        second = np.where(beyond < end_of[at], rank[np.minimum(beyond, n)], -1)
        by = np.lexsort((second, rank[at]))
        at, second = at[by], second[by]
        order[slots] = at
        group = rank[at]
        split = np.ones(len(at), bool)
        split[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        starts = np.flatnonzero(split)
        sizes = np.diff(np.append(starts, len(at)))
        rank[at] = np.repeat(slots[starts], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order, first_fresh


def repeat_lengths(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every position, the longest run from there that also starts elsewhere in the same sequence.

    Neighbours in the suffix array give it: a suffix lies in the deepest
    interval of common prefixes on its left or its right.
    """
    n = len(symbols)
    order, fresh = suffix_array(symbols, owner)
    longest = np.zeros(n, np.int64)
    pairs = np.flatnonzero(~fresh)
    if not len(pairs):
        return longest
    end = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, n)
    end_of = np.repeat(end, np.diff(np.append(0, end)))
    a, b = order[pairs - 1], order[pairs]
    common = common_prefix(RunHash(symbols), a, b, np.minimum(end_of[a] - a, end_of[b] - b))
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def sorted_suffixes(prefix: Prefix, symbols: np.ndarray, start: np.ndarray, length: int, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sort of the suffixes at ``start``, each compared over ``length`` symbols, within buckets.

    Two suffixes are compared by their common extension, found from prefix
    hashes by binary search, and the symbol after it.  All merges of a level
    run side by side: an element's place is its own rank plus its rank in the
    sibling run, found by binary search.  Returns the order and the common
    prefix of every suffix with the one before it in its bucket (0 for the
    first).
    """
    n = len(start)
    order = np.argsort(bucket, kind="stable")
    begins = np.ones(n, bool)
    begins[1:] = bucket[order][1:] != bucket[order][:-1]
    first = np.flatnonzero(begins)
    sizes = np.diff(np.append(first, n))
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    full = np.full(n, length, np.int64)
    width = 1
    while width < int(sizes.max(initial=0)):
        rank = np.arange(n) - base
        run = rank // width
        sibling = base + (run ^ 1) * width
        low, high = np.zeros(n, np.int64), np.clip(size - (run ^ 1) * width, 0, width)
        right = (run & 1) == 1
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            own, other = start[order[active]], start[order[sibling[active] + middle]]
            common = common_prefix(prefix, own, other, full[: len(active)])
            equal = common == length
            at = np.minimum(common, length - 1)
            below = np.where(equal, right[active], symbols[other + at] < symbols[own + at])
            low[active[below]] = middle[below] + 1
            high[active[~below]] = middle[~below]
            active = active[low[active] < high[active]]
        merged = np.empty_like(order)
        merged[base + (run // 2) * 2 * width + rank % width + low] = order
        order = merged
        width *= 2
    common = np.zeros(n, np.int64)
    inner = np.flatnonzero(~begins)
    common[inner] = common_prefix(prefix, start[order[inner - 1]], start[order[inner]], full[: len(inner)])
    return order, common

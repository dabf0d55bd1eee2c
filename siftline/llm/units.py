"""Encoding of a text by its distinct units: each is encoded once and remembered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from siftline.llm.arrays import Block, Strings, numbered, ragged, span_ids

#: Units and ids that a task remembers before it starts anew.
REMEMBERED = 1 << 19


class Memo:
    """Ids of units by their bytes; ``encode`` turns a list of new units into ids and their counts.

    Units are looked up by hash and compared by their bytes; the few that share
    a hash with another are kept by their bytes alone.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.start, self.count, self.ids = none, none, np.zeros(0, np.int32)
        # sorted hashes of the units in ``known``, their numbers there, and the slots of these
        self.hashes, self.slot = none.astype(np.uint64), none
        self.odd: dict[bytes, int] = {}

    def _add(self, units: list[bytes]) -> np.ndarray:
        """Slots of new units."""
        ids, count = self.encode(units)
        slots = len(self.count) + np.arange(len(units))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count))
        self.count, self.ids = np.concatenate((self.count, count)), np.concatenate((self.ids, ids))
        return slots

    def distinct(self, block: Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units data[start:end] by their bytes: number of each, one place of each number, and each number's slot in the memory."""
        if len(self.count) > self.remembered or len(self.ids) > 8 * self.remembered:
            self._forget()
        strings = Strings(block.data, start, end)
        found = numbered(strings)
        if found is None:
            which = span_ids(block.data, start, end)
            place = np.empty(int(which.max()) + 1, np.int64)
            place[which] = np.arange(len(which))
            return which, place, self._by_bytes(block, start[place], end[place])
        which, place = found
        hashes, slots = strings.hash[place], np.full(len(place), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            if len(hit):
                same = strings.equal(self.known, place[hit], self.slot[at[hit]])
                slots[hit[same]] = self.known_slot[self.slot[at[hit[same]]]]
                odd = hit[~same]
                if len(odd):
                    slots[odd] = self._by_bytes(block, start[place[odd]], end[place[odd]])
        new = np.flatnonzero(slots < 0)
        if len(new):
            text = block.data.tobytes()
            slots[new] = self._add([text[a:b] for a, b in zip(start[place[new]].tolist(), end[place[new]].tolist(), strict=True)])
            self._remember(strings, place[new], hashes[new], slots[new])
        return which, place, slots

    def _remember(self, strings: Strings, which: np.ndarray, hashes: np.ndarray, slots: np.ndarray) -> None:
        count = (strings.size[which] + 7) >> 3
        pieces = strings.pieces[ragged(strings.first[which], count)]
        first = np.cumsum(count) - count
        if not len(self.hashes):
            self.known, self.known_slot = Strings.__new__(Strings), slots
            self.known.size, self.known.first, self.known.pieces = strings.size[which], first, pieces
        else:
            known = self.known
            first = first + len(known.pieces)
            known.size, known.first = np.concatenate((known.size, strings.size[which])), np.concatenate((known.first, first))
            known.pieces, self.known_slot = np.concatenate((known.pieces, pieces)), np.concatenate((self.known_slot, slots))
        number = len(self.known_slot) - len(slots) + np.arange(len(slots))
        by = np.argsort(hashes)
        into = np.searchsorted(self.hashes, hashes[by])
        self.hashes, self.slot = np.insert(self.hashes, into, hashes[by]), np.insert(self.slot, into, number[by])

    def _by_bytes(self, block: Block, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        text = block.data.tobytes()
        units = [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        new = [u for u in units if u not in self.odd]
        if new:
            self.odd.update(zip(new, self._add(new).tolist(), strict=True))
        return np.array([self.odd[u] for u in units], np.int64)

    def ids_of(self, block: Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units data[start:end] one after the other, and the number of ids of each."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        which, _, slots = self.distinct(block, start, end)
        return self.ids_at(slots[which])

    def ids_at(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in these slots one after the other, and the number of ids of each."""
        count = self.count[slots]
        return self.ids[ragged(self.start[slots], count)], count


def per_text(count: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Number of ids of each text."""
    return np.bincount(owner, count, texts).astype(np.int64)

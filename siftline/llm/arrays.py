"""Texts of an Arrow batch as numpy arrays: bytes, words, hashes and sliding minima.

Every function works on a block of whole texts, so Python runs per block and
never per character.  A block holds about BLOCK_BYTES of text, or one text
that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_ROOT_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1 << 20, (1 << 63) - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
#: The letters and digits of ASCII and every byte of a longer UTF-8 character.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Powers:
    """Powers of the hash's root and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << int(n - 1).bit_length()
            factors = np.full(size, _ROOT)
            factors[0] = 1
            cls.up = np.cumprod(factors)
            factors[1:] = _ROOT_INVERSE
            cls.down = np.cumprod(factors)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Block:
    """Whole texts side by side: their bytes, and where each begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows = data, offsets, rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, texts: int = 1 << 14) -> Iterator[Block]:
    """The texts of a string column in order, at most ``texts`` in a block; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n, first + texts)
        lo, hi = offsets[first], offsets[last]
        yield Block(data[lo:hi], offsets[first : last + 1] - lo, slice(first, last))
        first = last


class Prefix:
    """Polynomial prefix hashes of a sequence; the hash of any run costs one subtraction and one product."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = Powers.of(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_640_531_527, 1_013_904_223)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Remainders modulo the prime 2^31 - 1."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


class RunHash:
    """Like ``Prefix``, for runs of any length: two polynomials modulo a prime, whose collisions do not follow the form of a sequence."""

    def __init__(self, values: np.ndarray):
        n, mixed = len(values), mix(values)
        self.parts = []
        for base, own in zip(_BASES, (mixed & _PRIME, mixed >> np.uint64(33)), strict=True):
            up, down = (self._powers(b, n + 1) for b in (base, pow(base, -1, int(_PRIME))))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_reduced(own * up[:n]), out=sums[1:])
            self.parts.append((sums, down))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        step = base
        while len(out) < n:
            out = np.concatenate((out, _reduced(out * np.uint64(step))))
            step = step * step % int(_PRIME)
        return out[:n]

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = (_reduced(_reduced(sums[end] - sums[start]) * down[start]) for sums, down in self.parts)
        return low | (high << np.uint64(31))


def byte_values(data: np.ndarray, lower: bool = False) -> np.ndarray:
    return (_BYTES[LOWER] if lower else _BYTES)[data]


class Strings:
    """The strings data[start:end] as masked 8-byte pieces, with their 64-bit hashes.

    A hash is a sum of mixed pieces, each with its place.  Unlike a polynomial,
    such a sum has no family of strings that collide by their form.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.size = end - start
        count = (self.size + 7) >> 3
        self.first = np.cumsum(count) - count
        self.owner = np.repeat(np.arange(len(start)), count)
        self.nth = np.arange(len(self.owner)) - self.first[self.owner]
        at = start[self.owner] + 8 * self.nth
        left = np.minimum(self.size[self.owner] - 8 * self.nth, 8)
        # the eight bytes from every position on, as one number; zeros stand behind the end
        loads = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).tobytes(), 0, (1,))
        self.pieces = loads[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
        out = mix(self.size.astype(np.uint64))
        heads = self.first[count > 0]
        if len(heads):
            out[count > 0] += np.add.reduceat(mix(self.pieces ^ mix(self.nth.astype(np.uint64) + _ROOT)), heads)
        self.hash = mix(out)

    def equal(self, other: Strings, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Whether string mine[k] has the bytes of string theirs[k] of ``other``."""
        same = self.size[mine] == other.size[theirs]
        mine, theirs, at = mine[same], theirs[same], np.flatnonzero(same)
        count = (self.size[mine] + 7) >> 3
        pieces = self.pieces[ragged(self.first[mine], count)] == other.pieces[ragged(other.first[theirs], count)]
        same[at[np.repeat(np.arange(len(mine)), count)[~pieces]]] = False
        return same


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings data[start:end] (see ``Strings``)."""
    return Strings(data, start, end).hash


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, equal for keys that agree in their high bits, and the first place of each number."""
    n = len(keys)
    bits = np.uint64(max(1, n.bit_length()))
    both = np.sort((keys >> bits << bits) | np.arange(n, dtype=np.uint64))
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = (both[1:] >> bits) != (both[:-1] >> bits)
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(fresh) - 1
    return which, order[fresh]


def numbered(strings: Strings) -> tuple[np.ndarray, np.ndarray] | None:
    """A number for each string, equal exactly for equal bytes, and a string of each number; None if two different ones share a hash."""
    which, first = _groups(strings.hash)
    like = first[which]
    if not (strings.size == strings.size[like]).all():
        return None
    same = strings.pieces == strings.pieces[strings.first[like][strings.owner] + strings.nth]
    return (which, first) if same.all() else None


def span_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each string data[start:end]; equal numbers mean equal bytes, which are compared."""
    if not len(start):
        return np.zeros(0, np.int64)
    found = numbered(Strings(data, start, end))
    if found:
        return found[0]
    # two strings with one hash: number them by their bytes
    known: dict[bytes, int] = {}
    text = data.tobytes()
    return np.array([known.setdefault(text[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)


class Words:
    """The words of a block: byte positions, 64-bit hashes, and the first word of each text in ``first``."""

    def __init__(self, block: Block, lower: bool = False, inside: np.ndarray = IS_WORD, hashes: bool = True):
        data = LOWER[block.data] if lower else block.data
        self.data = data
        n = len(data)
        is_word = inside[data]
        edge = np.zeros(n + 1, bool)
        edge[block.offsets] = True
        begins, stops = is_word.copy(), is_word.copy()
        begins[1:] &= ~is_word[:-1] | edge[1:n]
        stops[:-1] &= ~is_word[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, block.offsets)
        self.count = np.diff(self.first)
        if hashes:
            self.hash = span_hashes(data, self.start, self.end)

    def ids(self) -> np.ndarray:
        """A number for each word, equal exactly for equal words of this block."""
        return span_ids(self.data, self.start, self.end)

    def doc(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Positions at which ``size`` items of one text stand in a row; ``first`` holds the texts' bounds."""
    n = int(first[-1])
    if n < size:
        return np.zeros(0, np.int64)
    fits = np.zeros(n + 1, np.int64)
    lengths = np.diff(first)
    long = lengths >= size
    np.add.at(fits, first[:-1][long], 1)
    np.add.at(fits, first[1:][long] - size + 1, -1)
    return np.flatnonzero(np.cumsum(fits[:n]) > 0)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for count[0] values, then start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return shift + np.arange(total)


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions some half-open interval covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    return np.cumsum(change[:n]) > 0


def bounds_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values))


def packed(columns: np.ndarray) -> bytes:
    """Rows of 64-bit integers, byte by byte of equal weight, so that small numbers shrink well."""
    return np.ascontiguousarray(columns).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()


def unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(rows, 8, -1).transpose(0, 2, 1).copy().view(np.int64)[..., 0]

"""One pass over a text finds every term of a pack, whatever the pack's size.

A term is looked up by its first characters (at most HEAD): the text's grams
are hashed for all positions at once, positions whose gram begins some term
are candidates, and the characters decide.  The pack goes to the tasks in
blocks of TERMS_AT_ONCE terms, so that what is broadcast is bounded; every
block is the same narrow pass, and small packs are one block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from siftline.session import small_batches

HEAD = 8
TERMS_AT_ONCE = 100_000
#: Characters of text that are looked through at once.
CHARS_AT_ONCE = 1 << 18
COMPARED_AT_ONCE = 1 << 20

HIT = D.StructType(
    [D.StructField(n, D.StringType()) for n in ("surface", "term", "ktype", "category", "stage")]
    + [D.StructField("count", D.IntegerType()), D.StructField("snippet", D.StringType())]
)


class Surface(NamedTuple):
    """One spelling to look for, and what it stands for."""

    surface: str
    term: str
    ktype: str
    category: str
    stage: str


class Exclusion(NamedTuple):
    """Words that take off the occurrences of a term that stand near them."""

    term: str
    exclude_if: tuple[str, ...]
    before: int
    after: int


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _gram_hashes(codes: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each size with the hashes of all grams of that size; a longer gram's hash goes on from a shorter one's."""
    wide, raw = codes.astype(np.uint64), np.zeros(len(codes), np.uint64)
    done = 0
    for n in sorted(sizes):
        for i in range(done, n):
            raw = raw[: max(0, len(codes) - i)] * np.uint64(0x9E3779B97F4A7C15) + wide[i:]
        done = n
        yield n, (raw ^ (raw >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class _Class:
    """Terms whose head has one length: sorted head hashes, and the terms of each."""

    door: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    terms: np.ndarray


class TermIndex:
    """Distinct surfaces by their heads, with their characters."""

    def __init__(self, surfaces: Iterable[str]):
        self.surfaces = sorted({s for s in surfaces if s})
        self.size = np.array([len(s) for s in self.surfaces], np.int64)
        self.classes: dict[int, _Class] = {}
        heads = np.minimum(self.size, HEAD)
        for n in np.unique(heads).tolist():
            terms = np.flatnonzero(heads == n)
            (_, hashes), = _gram_hashes(_codes("".join(self.surfaces[t][:n] for t in terms.tolist())), [n])
            hashes = hashes[::n]
            by = np.argsort(hashes, kind="stable")
            unique, first = np.unique(hashes[by], return_index=True)
            door = np.zeros(1 << 16, bool)
            door[(unique >> np.uint64(48)).astype(np.int64)] = True
            self.classes[n] = _Class(door, unique, np.append(first, len(by)), terms[by])
        self.codes = {n: _codes("".join(self.surfaces[t] for t in np.flatnonzero(self.size == n).tolist())).reshape(-1, n) for n in np.unique(self.size).tolist()}
        self.row = np.zeros(len(self.surfaces), np.int64)
        for n in self.codes:
            at = np.flatnonzero(self.size == n)
            self.row[at] = np.arange(len(at))

    def occurrences(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, term) of every occurrence; ``end`` is where each position's text ends."""
        places, terms = [], []
        for n, hashes in _gram_hashes(codes, self.classes):
            c = self.classes[n]
            at = np.flatnonzero(c.door[(hashes >> np.uint64(48)).astype(np.int64)])
            near = np.minimum(np.searchsorted(c.hashes, hashes[at]), len(c.hashes) - 1)
            hit = c.hashes[near] == hashes[at]
            at, near = at[hit], near[hit]
            count = c.first[near + 1] - c.first[near]
            shift = np.repeat(c.first[near] - (np.cumsum(count) - count), count)
            places.append(np.repeat(at, count))
            terms.append(c.terms[shift + np.arange(len(shift))])
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        term = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        fits = place + self.size[term] <= end[place] if len(place) else np.zeros(0, bool)
        place, term = place[fits], term[fits]
        same = np.zeros(len(place), bool)
        for n in np.unique(self.size[term]).tolist():
            rows = np.flatnonzero(self.size[term] == n)
            step = max(1, COMPARED_AT_ONCE // n)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                found = codes[place[part][:, None] + np.arange(n)]
                same[part] = (found == self.codes[n][self.row[term[part]]]).all(axis=1)
        return place[same], term[same]

    def grouped(self, texts: list[str]) -> Grouped:
        """All occurrences in several texts, by text, term and position."""
        lengths = np.array([len(t) for t in texts], np.int64)
        stops = np.cumsum(lengths)
        codes = _codes("".join(texts))
        place, term = self.occurrences(codes, np.repeat(stops, lengths))
        text = np.searchsorted(stops, place, "right")
        by = np.lexsort((place, term, text))
        place, term, text = place[by], term[by], text[by]
        new = np.ones(len(by), bool)
        new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
        begin = np.flatnonzero(new)
        close = np.zeros(len(by), bool)
        close[1:] = ~new[1:] & (place[1:] - place[:-1] < self.size[term[1:]])
        overlaps = np.add.reduceat(close, begin) > 0 if len(begin) else np.zeros(0, bool)
        end = np.append(begin[1:], len(by)) if len(begin) else begin
        return Grouped(text[begin], term[begin], begin, end, place - (stops - lengths)[text] if len(by) else place, overlaps)

    def apart(self, places: list[int], term: int) -> list[int]:
        """The occurrences that a front-to-back search finds, each beginning behind the one before."""
        out, free = [], -1
        for p in places:
            if p >= free:
                out.append(p)
                free = p + int(self.size[term])
        return out

    def counted(self, texts: list[str], exclusions: dict[int, tuple[Exclusion, list[int]]] | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(text, term, first position, occurrences that do not overlap) in order of text and term.

        ``exclusions``: for a term, the rule that takes off some of its
        occurrences, and the terms of the rule's excluding words.
        """
        found = self.grouped(texts)
        spans = found.spans() if exclusions else {}
        for k, (i, term, a, b, overlapping) in enumerate(zip(*(x.tolist() for x in (found.text, found.term, found.begin, found.end, found.overlaps)), strict=True)):
            if exclusions and term in exclusions:
                rule, words = exclusions[term]
                n = len(self.kept(texts[i], i, term, rule, words, found, spans))
            elif overlapping:
                n = len(self.apart(found.place[a:b].tolist(), term))
            else:
                n = b - a
            yield i, term, int(found.place[a]), n

    def kept(self, text: str, i: int, term: int, rule: Exclusion, words: list[int], found: Grouped, spans: dict[tuple[int, int], int]) -> list[int]:
        """Occurrences of a term in text ``i`` without an excluding word between ``before`` characters ahead and ``after`` behind it."""
        size = int(self.size[term])
        listed = found.listed
        near = [(int(self.size[w]), int(found.begin[k]), int(found.end[k])) for w in words if (k := spans.get((i, w))) is not None]
        out = []
        for p in self.standing(spans[i, term], term, found):
            lo, hi = max(0, p - rule.before), min(len(text), p + size + rule.after)
            if not any((at := bisect_left(listed, lo, a, b)) < b and listed[at] + n <= hi for n, a, b in near):
                out.append(p)
        return out

    def standing(self, k: int, term: int, found: Grouped) -> list[int]:
        """The places of entry ``k`` that do not overlap."""
        places = found.listed[found.begin[k] : found.end[k]]
        return self.apart(places, term) if found.overlaps[k] else places


@dataclass
class Grouped:
    """Occurrences by text and term: one entry for each pair, and the pairs' places within their texts."""

    text: np.ndarray
    term: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    place: np.ndarray
    overlaps: np.ndarray

    @cached_property
    def listed(self) -> list[int]:
        """The places as a list, for looking up a few."""
        return self.place.tolist()

    def spans(self) -> dict[tuple[int, int], int]:
        """The entry of each (text, term)."""
        return {pair: k for k, pair in enumerate(zip(self.text.tolist(), self.term.tolist(), strict=True))}


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded length in sum, or one text that is longer."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHARS_AT_ONCE:
            yield lo, [x or "" for x in texts[lo:i]]
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, [x or "" for x in texts[lo:]]


def snippet(text: str, start: int, size: int, radius: int) -> str:
    cut = text[max(0, start - radius) : start + size + radius].strip("…")
    return f"…{cut}…"


def in_blocks(rows: Iterable, size: int = TERMS_AT_ONCE) -> Iterator[list]:
    block: list = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _with_block(docs: DataFrame, columns: list[tuple[str, list[Surface]]], text: str, radius: int, exclusions: dict[str, Exclusion]) -> DataFrame:
    by_surface: dict[str, list[tuple[int, Surface]]] = {}
    for c, (_, rows) in enumerate(columns):
        for r in rows:
            by_surface.setdefault(r.surface, []).append((c, r))
    rules = {s: exclusions[s] for s in by_surface if s in exclusions}
    index = TermIndex([*by_surface, *(w for r in rules.values() for w in r.exclude_if)])
    number = {s: i for i, s in enumerate(index.surfaces)}
    meanings = [by_surface.get(s, []) for s in index.surfaces]
    # an empty word is near everything
    nearby = {number[s]: (r._replace(before=0, after=0), [number[s]]) if "" in r.exclude_if else (r, [number[w] for w in r.exclude_if]) for s, r in rules.items() if s}
    shared = docs.sparkSession.sparkContext.broadcast((index, meanings, nearby))
    names, all_names = [n for n, _ in columns], [*docs.columns, *(n for n, _ in columns)]
    schema = D.StructType([*docs.schema.fields, *(D.StructField(n, D.ArrayType(HIT)) for n in names)])
    read = docs.withColumn("_matched_text", F.expr(text))
    item = pa.struct([(f.name, pa.int32() if f.name == "count" else pa.string()) for f in HIT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, meanings, nearby = shared.value
        for batch in batches:
            texts = batch.column("_matched_text").to_pylist()
            for lo, part in _slices(texts):
                found: list[list[list[dict]]] = [[[] for _ in part] for _ in names]
                for i, term, start, n in index.counted(part, nearby):
                    if not n or not meanings[term]:
                        continue
                    surface = index.surfaces[term]
                    near = snippet(part[i], start, len(surface), radius)
                    for c, m in meanings[term]:
                        found[c][i].append({**m._asdict(), "count": n, "snippet": near})
                for each in found:
                    for hits in each:
                        hits.sort(key=lambda h: (h["surface"], h["ktype"], h["category"], h["term"]))
                own = batch.slice(lo, len(part)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.list_(item)) for x in found)], names=all_names)

    return small_batches(read).mapInArrow(run, schema)


def attach_hits(
    docs: DataFrame, packs: dict[str, list[Surface]], text: str = "text", radius: int = 25, exclusions: Iterable[Exclusion] = (),
) -> DataFrame:
    """``docs`` plus, for each named pack, an array of its hits in the text, sorted by surface.

    One narrow pass for all packs (for each block of terms, if there are more
    than fit in one).  NULL texts have no hits.  Occurrences that an exclusion
    takes off are not counted, and a hit with none left is dropped; the first
    rule of a term holds.
    """
    rules: dict[str, Exclusion] = {}
    for rule in exclusions:
        rules.setdefault(rule.term, rule)
    rows = sorted((r.surface, r.ktype, r.category, name, r) for name, pack in packs.items() for r in pack)
    parts: list[dict[str, str]] = []
    for block in in_blocks(rows):
        columns = [(f"_{name}_{len(parts)}", [r for _, _, _, owner, r in block if owner == name]) for name in packs]
        docs = _with_block(docs, columns, text, radius, rules)
        parts.append({name: column for name, (column, _) in zip(packs, columns, strict=True)})
    none = F.lit(None).cast(D.ArrayType(HIT))
    joined = {name: F.concat(*(F.col(p[name]) for p in parts)) if parts else F.coalesce(none, F.array().cast(D.ArrayType(HIT))) for name in packs}
    return docs.withColumns(joined).drop(*(c for p in parts for c in p.values()))


def term_hits(docs: DataFrame, surfaces: DataFrame, text: str = "text", radius: int = 25) -> DataFrame:
    """doc_id and the fields of a hit, one row for each hit; ``surfaces`` has the fields of ``Surface``."""
    ordered = surfaces.select(*Surface._fields).orderBy("surface", "ktype", "category", "term")
    texts = docs.select("doc_id", F.expr(text).alias("_body"))
    out = None
    for block in in_blocks(ordered.toLocalIterator()):
        hits = _with_block(texts, [("_hits", [Surface(*r) for r in block])], "_body", radius, {})
        rows = hits.select("doc_id", F.explode("_hits").alias("_hit")).select("doc_id", "_hit.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = texts.select("doc_id", F.explode(F.array().cast(D.ArrayType(HIT))).alias("_hit")).select("doc_id", "_hit.*")
    return out

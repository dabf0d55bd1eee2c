"""Patterns, context exclusions and negative rules from the positions of their words.

One look at a text finds where every word of every rule stands (see
``matcher``).  From there on only words that occur cost anything: a word leads
to the groups and rules that hold it, and a rule is looked at only when enough
of it is there.

* A pattern's windows are kept as bits.  Each word has one bit for every
  sentence (paragraph) it stands in, a group is the union of its words, and the
  groups' intersection has the windows that hold all of them; its lowest bit is
  the first.  Three sentences in a row are the same bits, shifted.
* An exclusion is an interval test on sorted positions.
* A negative rule is tested when one of the words it asks for is there.

Rules go to the tasks as broadcast tables in blocks of bounded size, each a
narrow pass, so neither the plan nor a task grows with the pack.  NULL texts
have no hits; empty texts hold only what empty words and flags fill.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from siftline.functions import text as T
from siftline.operators import matcher
from siftline.operators.matcher import Exclusion, Grouped, TermIndex, _slices
from siftline.session import small_batches

NONE = "cast(array() AS array<string>)"
DYNAMIC = ("amount", "reversal", "entity", "flag")
#: Up to here plain Python is quicker than numpy's calls.
FEW_PLACES = 64


def _structs(**fields: D.DataType) -> D.ArrayType:
    return D.ArrayType(D.StructType([D.StructField(n, t) for n, t in fields.items()]))


_TEXT, _WORDS = D.StringType(), D.ArrayType(D.StringType())
PATTERN_HIT = _structs(
    pattern_id=_TEXT, category=_TEXT, score=D.DoubleType(), level=_TEXT, window_no=D.IntegerType(), matched_terms=_WORDS, snippet=_TEXT
)
NEGATIVE_HIT = _structs(rule_id=_TEXT, delta=D.DoubleType(), cap=D.DoubleType(), matched_terms=_WORDS)
EXCLUSION_COUNT = _structs(term=_TEXT, total=D.IntegerType(), kept=D.IntegerType())
_SPACES = r"[ \t\n\x0b\f\r]"
_PARAGRAPH = re.compile(rf"\n{_SPACES}*\n")


class Negative(NamedTuple):
    """A rule over the words, hit types and flags of a document."""

    rule_id: str
    require: tuple[str, ...]
    min_count: int
    also: tuple[str, ...]
    forbid: tuple[str, ...]
    forbid_types: tuple[str, ...]
    flags: tuple[str, ...]
    delta: float
    cap: float | None


class Rules(NamedTuple):
    """A block of rules; patterns are those of ``siftline.operators.patterns``."""

    patterns: tuple = ()
    exclusions: tuple[Exclusion, ...] = ()
    negatives: tuple[Negative, ...] = ()

    def words(self) -> set[str]:
        out = {t for p in self.patterns for kind, terms in p.groups if kind == "term" for t in terms}
        out.update(w for e in self.exclusions for w in (e.term, *e.exclude_if))
        out.update(w for n in self.negatives for w in (*n.require, *n.also, *n.forbid))
        return out


def rule_blocks(kind: str, rules: Iterable, limit: int | None = None) -> Iterator[Rules]:
    """Rules of one kind, in blocks of about ``limit`` words."""
    limit = limit or matcher.TERMS_AT_ONCE
    held, size = [], 0
    for rule in rules:
        words = len(Rules(**{kind: (rule,)}).words()) + 1
        if held and size + words > limit:
            yield Rules(**{kind: tuple(held)})
            held, size = [], 0
        held.append(rule)
        size += words
    if held:
        yield Rules(**{kind: tuple(held)})


class _Windows:
    """The windows of one text, and for each word the windows it stands in, as bits."""

    def __init__(self, text: str, ends: str):
        self.text, self.ends = text, ends
        self._spans: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.numbers = re.compile(f"[0-9][0-9,，.]*{_SPACES}*(?:万亿|萬億|万|萬|亿|億)?")

    def spans(self, level: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the trimmed sentences or paragraphs."""
        if level not in self._spans:
            text, pieces, at = self.text, [], 0
            if level == "sentence":
                for m in re.finditer("[" + re.escape(self.ends) + "\n" + T.SEPARATOR + "]", text) if self.ends else re.finditer("\n", text):
                    stop = m.start() if m.group() in "\n" + T.SEPARATOR else m.end()
                    pieces.append((at, stop))
                    at = m.end()
            else:
                for m in _PARAGRAPH.finditer(text):
                    pieces.append((at, m.start()))
                    at = m.end()
            pieces.append((at, len(text)))
            out = []
            for lo, hi in pieces:
                piece = text[lo:hi]
                if level == "sentence" and len(piece) == 1 and piece in self.ends:
                    continue
                left = piece.lstrip(T.BLANKS)
                if left:
                    begin = hi - len(left)
                    out.append((begin, begin + len(left.rstrip(T.BLANKS))))
            rows = np.array(out, np.int64).reshape(-1, 2)
            self._spans[level] = rows[:, 0], rows[:, 1]
        return self._spans[level]

    def count(self, level: str) -> int:
        return 1 if level == "full" else len(self.spans("paragraph" if level == "paragraph" else "sentence")[0])

    def window(self, level: str, k: int) -> str:
        if level == "full":
            return self.text
        starts, stops = self.spans("paragraph" if level == "paragraph" else "sentence")
        last = k + 3 if level == "context3" else k + 1
        return "\n".join(self.text[a:b] for a, b in zip(starts[k:last].tolist(), stops[k:last].tolist(), strict=True))

    def bits(self, level: str, places: np.ndarray, size: int, word: str = "") -> int:
        """The windows in which a word of ``size`` characters at ``places`` stands, as bits."""
        if not len(places):
            return 0
        if level == "full":
            return 1
        if level == "context3":
            if "\n" in word:  # sentences are joined anew by line breaks, which such a word may hold
                return sum(1 << k for k in range(self.count(level)) if word in self.window(level, k))
            one = self.bits("sentence", places, size)
            return one | (one >> 1) | (one >> 2)
        starts, stops = self.spans(level)
        if not len(starts):
            return 0
        at = np.searchsorted(starts, places, "right") - 1
        at = np.unique(at[(at >= 0) & (places + size <= stops[np.maximum(at, 0)])])
        if len(at) < 8:
            return sum(1 << k for k in at.tolist())
        marks = np.zeros(len(starts), np.uint8)
        marks[at] = 1
        return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")

    def word_bits(self, level: str, words: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> dict[int, int]:
        """``bits`` of many words at once; a row for each place, by word and place."""
        starts, stops = self.spans(level)
        if not len(starts):
            return {}
        if len(words) < FEW_PLACES:
            begins, ends, few = starts.tolist(), stops.tolist(), {}
            for w, place, size in zip(words.tolist(), places.tolist(), sizes.tolist(), strict=True):
                k = bisect_right(begins, place) - 1
                if k >= 0 and place + size <= ends[k]:
                    few[w] = few.get(w, 0) | 1 << k
            return few
        at = np.searchsorted(starts, places, "right") - 1
        inside = np.flatnonzero((at >= 0) & (places + sizes <= stops[np.maximum(at, 0)]))
        words, at = words[inside], at[inside]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (words[1:] != words[:-1]) | (at[1:] != at[:-1])
        words, at = words[fresh], at[fresh]
        begin = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else words
        out, held = {}, at.tolist()
        for w, lo, hi in zip(words[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(at)], strict=False):
            if hi - lo < 8:
                bits = 0
                for k in held[lo:hi]:
                    bits |= 1 << k
            else:
                marks = np.zeros(len(starts), np.uint8)
                marks[at[lo:hi]] = 1
                bits = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
            out[w] = bits
        return out

    def places(self, word: str) -> np.ndarray:
        """All places of a word that is not in the index."""
        out, at = [], self.text.find(word)
        while at >= 0:
            out.append(at)
            at = self.text.find(word, at + 1)
        return np.array(out, np.int64)


class RuleIndex:
    """A block of rules by their words."""

    def __init__(self, rules: Rules, ends: str):
        self.rules, self.ends = rules, ends
        self.index = TermIndex(rules.words())
        number = {s: i for i, s in enumerate(self.index.surfaces)}
        n = len(number)
        pairs, self.groups, self.static, self.kinds = [], [], [], []
        for p, pattern in enumerate(rules.patterns):
            static, kinds = 0, 0
            for kind, terms in pattern.groups:
                g = len(self.groups)
                words = [number[t] for t in terms if t] if kind == "term" else []
                self.groups.append((p, kind, words))
                pairs += [(w, g) for w in words]
                static += kind == "term"
                kinds |= 1 << DYNAMIC.index(kind) if kind in DYNAMIC else 0 if kind == "term" else 1 << len(DYNAMIC)
            self.static.append(static)
            self.kinds.append(kinds)
        self.static, self.kinds = np.array(self.static, np.int64), np.array(self.kinds, np.int64)
        self.open = np.flatnonzero(self.static == 0)
        # words to the groups that hold them
        by = np.array(sorted(set(pairs)), np.int64).reshape(-1, 2)
        self.first, self.of_word = np.searchsorted(by[:, 0], np.arange(n + 1)), by[:, 1]
        self.pattern_of = np.array([g[0] for g in self.groups], np.int64)
        self.group_first = np.searchsorted(self.pattern_of, np.arange(len(rules.patterns) + 1))
        groups = [g[1:] for g in self.groups]
        self.plans = [
            (pattern.levels(), groups[self.group_first[p] : self.group_first[p + 1]], float(pattern.score())) for p, pattern in enumerate(rules.patterns)
        ]
        self.breaks = {w for t, w in number.items() if "\n" in t}
        self.number = number
        self.excluded = {}
        for k, e in enumerate(rules.exclusions):
            self.excluded.setdefault(number[e.term], []).append(k)
        self.near = [[number[w] for w in e.exclude_if if w] for e in rules.exclusions]
        self.asked, self.always = {}, []
        for k, r in enumerate(rules.negatives):
            if r.min_count <= sum(1 for w in r.require if not w):
                self.always.append(k)
            else:
                for w in {number[w] for w in r.require if w}:
                    self.asked.setdefault(w, []).append(k)

    def candidates(self, found: Grouped, texts: int, kinds: np.ndarray) -> dict[int, list[int]]:
        """For each text the patterns whose groups may all be filled; ``kinds`` has the dynamic groups that a text can fill, as bits."""
        out: dict[int, list[int]] = {}
        if len(self.of_word) and len(found.term):
            count = self.first[found.term + 1] - self.first[found.term]
            shift = np.repeat(self.first[found.term] - (np.cumsum(count) - count), count)
            group = self.of_word[shift + np.arange(len(shift))]
            # sorted, as a set by hashing is slower on this many
            pair = np.sort(np.repeat(found.text, count) * len(self.groups) + group)
            pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
            text, pattern = pair // len(self.groups), self.pattern_of[pair % len(self.groups)]
            both, filled = np.unique(text * len(self.static) + pattern, return_counts=True)
            text, pattern = both // len(self.static), both % len(self.static)
            fits = (filled == self.static[pattern]) & (self.kinds[pattern] & ~kinds[text] == 0)
            for i, p in zip(text[fits].tolist(), pattern[fits].tolist(), strict=True):
                out.setdefault(i, []).append(p)
        if len(self.open):
            for i in range(texts):
                more = self.open[self.kinds[self.open] & ~kinds[i] == 0].tolist()
                if more:
                    out[i] = sorted(out.get(i, []) + more)
        return out

    def pattern_hits(self, text: str, patterns: list[int], terms: np.ndarray, places: np.ndarray, dynamic: dict[str, list[str]]) -> list[tuple]:
        """Hits as values of PATTERN_HIT; ``terms`` and ``places`` are those of the text, by term and place."""
        windows, known, hits, surfaces = _Windows(text, self.ends), {}, [], self.index.surfaces
        at_word: dict[str, dict[int, int]] = {}
        everywhere: dict[str, int] = {}

        def words_at(level: str) -> dict[int, int]:
            """The windows of every word of the text."""
            if level not in at_word:
                if level == "full":
                    at_word[level] = dict.fromkeys(terms.tolist(), 1)
                elif level == "context3":
                    at_word[level] = {w: b | (b >> 1) | (b >> 2) for w, b in words_at("sentence").items()}
                    for w in self.breaks.intersection(terms.tolist()):
                        at_word[level][w] = windows.bits(level, places[terms == w], int(self.index.size[w]), surfaces[w])
                else:
                    at_word[level] = windows.word_bits(level, terms, places, self.index.size[terms])
            return at_word[level]

        def text_bits(level: str, t: str) -> int:
            if not t:
                return (1 << windows.count(level)) - 1
            if (level, t) not in known:
                known[level, t] = windows.bits(level, windows.places(t), len(t), t)
            return known[level, t]

        def digit_bits(level: str) -> int:
            if (level, None) not in known:
                places = np.array([m.start() for m in re.finditer("[0-9]", text)], np.int64)
                known[level, None] = windows.bits(level, places, 1)
            return known[level, None]

        def group_bits(level: str, kind: str, held: list[int]) -> int:
            out = 0
            if kind == "term":
                there = words_at(level)
                for w in held:
                    out |= there.get(w, 0)
            elif kind == "flag":
                out = (1 << windows.count(level)) - 1 if dynamic["flag"] else 0
            else:
                for t in dynamic[kind]:
                    out |= text_bits(level, t)
                if kind == "amount":
                    out |= digit_bits(level)
            return out

        def first_term(level: str, bit: int, kind: str, held: list[int]) -> str:
            if kind == "term":
                there = words_at(level)
                return next((surfaces[w] for w in held if there.get(w, 0) & bit), "")
            if kind == "flag":
                return ""
            given = next((t for t in dynamic[kind] if text_bits(level, t) & bit), None)
            if given is None and kind == "amount":
                given = windows.numbers.search(windows.window(level, bit.bit_length() - 1)).group().replace(" ", "")
            return given or ""

        first = {}
        for p in patterns:
            pattern = self.rules.patterns[p]
            levels, groups, score = self.plans[p]
            for level in levels:
                if level == "full" and pattern.full_limit is not None and len(text) > pattern.full_limit:
                    continue
                if level not in everywhere:
                    everywhere[level] = (1 << windows.count(level)) - 1
                bits = everywhere[level]
                for kind, held in groups:
                    bits &= words_at(level).get(held[0], 0) if kind == "term" and len(held) == 1 else group_bits(level, kind, held)
                    if not bits:
                        break
                if bits:
                    bit = bits & -bits
                    named = [t for t in (surfaces[g[1][0]] if g[0] == "term" and len(g[1]) == 1 else first_term(level, bit, *g) for g in groups) if t]
                    if named:
                        head = named[0]
                        if head not in first:
                            at = max(text.find(head) + 1 - 30, 1) - 1
                            first[head] = "…" + text[at : at + 140 + len(head)].replace("\n", " ") + "…"
                        near = first[head]
                    else:
                        near = text[:120]
                    hits.append((pattern.pattern_id, pattern.category, score, level, bit.bit_length() - 1, named, near))
                    break
        return hits

    def exclusion_counts(self, text: str, i: int, terms: list[int], found: Grouped, spans: dict[tuple[int, int], int]) -> list[tuple]:
        out = []
        for k in sorted(k for w in terms for k in self.excluded.get(w, ())):
            rule = self.rules.exclusions[k]
            w = self.number[rule.term]
            total = len(self.index.standing(spans[i, w], w, found))
            kept = 0 if "" in rule.exclude_if else len(self.index.kept(text, i, w, rule, self.near[k], found, spans))
            out.append((rule.term, total, kept))
        return out

    def negative_hits(self, terms: list[int], types: list[str], flags: list[str]) -> list[tuple]:
        held = {"", *(self.index.surfaces[w] for w in terms)}
        out = []
        for k in sorted({*self.always, *(k for w in terms for k in self.asked.get(w, ()))}):
            r = self.rules.negatives[k]
            there = [w for w in r.require if w in held]
            if (len(there) >= r.min_count and (not r.also or not held.isdisjoint(r.also)) and held.isdisjoint(r.forbid)
                    and not set(r.forbid_types) & set(types) and set(r.flags) <= set(flags)):
                out.append((r.rule_id, r.delta, r.cap, there))
        return out

    def apply(self, texts: list[str | None], amounts: list, reversals: list, entities: list, flag: list, types: list, flags: list) -> tuple[list, list, list]:
        """Pattern hits, exclusion counts and negative hits of each text, as tuples of their fields."""
        body = [t or "" for t in texts]
        found = self.index.grouped(body)
        bounds = np.searchsorted(found.text, np.arange(len(body) + 1)).tolist()
        kinds = np.array(
            [bool(amounts[i]) | bool(re.search("[0-9]", t)) | bool(reversals[i]) << 1 | bool(entities[i]) << 2 | bool(flag[i]) << 3 for i, t in enumerate(body)], np.int64
        ) if self.kinds.any() else np.zeros(len(body), np.int64)
        wanted = self.candidates(found, len(body), kinds) if self.rules.patterns else {}
        spans = found.spans() if self.excluded else {}
        out: tuple[list, list, list] = ([], [], [])
        for i, text in enumerate(body):
            terms = found.term[bounds[i] : bounds[i + 1]].tolist()
            if texts[i] is None:
                for x in out:
                    x.append([])
                continue
            hits = []
            if i in wanted:
                own = slice(bounds[i], bounds[i + 1])
                count = found.end[own] - found.begin[own]
                # a text's places lie side by side, by term
                lo = int(found.begin[bounds[i]]) if len(count) else 0
                places = found.place[lo : lo + int(count.sum())]
                given = {k: [t for t in x[i] or [] if t is not None] for k, x in (("amount", amounts), ("reversal", reversals), ("entity", entities))}
                given["flag"] = flag[i]
                hits = self.pattern_hits(text, wanted[i], np.repeat(found.term[own], count), places, given)
            out[0].append(hits)
            out[1].append(self.exclusion_counts(text, i, terms, found, spans) if self.excluded else [])
            out[2].append(self.negative_hits(terms, types[i] or [], flags[i] or []) if self.rules.negatives else [])
        return out


def attach_rules(
    docs: DataFrame, blocks: Iterable[Rules], text: str = "text", patterns: str | None = None, exclusions: str | None = None, negatives: str | None = None,
    amounts: str = NONE, reversals: str = NONE, entities: str = NONE, flag: str = "false", types: str = NONE, flags: str = NONE,
    ends: str = T.SENTENCE_ENDS, keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus arrays, under the given names, of pattern hits, exclusion counts and negative hits.

    The other parameters are SQL expressions: strings that fill the dynamic
    groups of patterns, and the hit types and flags that negative rules ask for.
    """
    names = {0: patterns, 1: exclusions, 2: negatives}
    wanted = {k: n for k, n in names.items() if n}
    kinds = {0: PATTERN_HIT, 1: EXCLUSION_COUNT, 2: NEGATIVE_HIT}
    given = {"text": text, "amounts": amounts, "reversals": reversals, "entities": entities, "flag": flag, "types": types, "flags": flags}
    inputs = {f"_rule_{k}": F.expr(v).cast("boolean" if k == "flag" else "string" if k == "text" else "array<string>") for k, v in given.items()}
    parts: dict[int, list[str]] = {k: [] for k in wanted}
    own = docs.columns if keep is None else keep
    docs = docs.select(*own, *(c.alias(n) for n, c in inputs.items()))
    for n_blocks, rules in enumerate(blocks, 1):
        shared = docs.sparkSession.sparkContext.broadcast(RuleIndex(rules, ends))
        added = {k: f"_rule_{k}_{n_blocks}" for k in wanted if (rules.patterns, rules.exclusions, rules.negatives)[k]}
        schema = D.StructType([*docs.schema.fields, *(D.StructField(c, kinds[k]) for k, c in added.items())])
        arrow, read_names, all_names = {k: _arrow(kinds[k]) for k in added}, list(inputs), schema.names

        def run(batches: Iterator[pa.RecordBatch], shared=shared, added=added, arrow=arrow, read_names=read_names, all_names=all_names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                read = [batch.column(c).to_pylist() for c in read_names]
                for lo, part in _slices(read[0]):
                    hi = lo + len(part)
                    found = shared.value.apply(*(x[lo:hi] for x in read))
                    columns = [_column(found[k], arrow[k]) for k in added]
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(part)).columns, *columns], names=all_names)

        docs = small_batches(docs).mapInArrow(run, schema)
        for k, c in added.items():
            parts[k].append(c)
    joined = {wanted[k]: F.concat(*(F.col(c) for c in parts[k])) if parts[k] else F.array().cast(kinds[k]) for k in wanted}
    return docs.withColumns(joined).select(*own, *(n for n in wanted.values() if n not in own))


def _arrow(kind: D.DataType) -> pa.DataType:
    if isinstance(kind, D.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, D.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {D.StringType: pa.string(), D.DoubleType: pa.float64(), D.IntegerType: pa.int32()}[type(kind)]


def _column(lists: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs."""
    rows = [r for x in lists for r in x]
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    fields = list(kind.value_type)
    values = zip(*rows, strict=True) if rows else ([] for _ in fields)
    structs = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets), structs).cast(kind)


def negative_rules(rows: Iterable) -> Iterator[Negative]:
    """rule_negatives rows: rule_id, require, min_count, also, forbid, forbid_types, flags, delta, cap."""
    for r in rows:
        lists = (tuple(getattr(r, n) or ()) for n in ("also", "forbid", "forbid_types", "flags"))
        yield Negative(r.rule_id, tuple(r.require or ()), int(r.min_count), *lists, float(r.delta), None if r.cap is None else float(r.cap))


def exclusion_rules(rows: Iterable) -> Iterator[Exclusion]:
    """rule_exclusions rows: term, exclude_if, before, after.  Terms of one character say too little and are left out."""
    for r in rows:
        if len(r.term) >= 2:
            yield Exclusion(r.term.lower(), tuple(x.lower() for x in r.exclude_if or ()), int(r.before), int(r.after))


def in_groups(rows: Iterable, key: str) -> Iterator[list]:
    """Runs of rows with one value of ``key``."""
    for _, group in groupby(rows, key=lambda r: r[key]):
        yield list(group)

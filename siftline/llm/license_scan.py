"""Operator 4, license scan: ordered signature rules behind a keyword gate.

A rule is a regular expression over a text's words (lower-case A-Z, runs of
letters and digits, joined by single spaces) with a gate word that every match
contains.  Gate words are found for whole blocks at once by hash; only the
words around them are joined and searched, and only with the rules of the gate
words that stand there.  Every rule spans less than REACH words, so nothing
is lost.

Rules are ordered.  A detection inside one of an earlier rule, or of the same
rule and longer, is suppressed; base phrases always count for the base columns
and labels.  The score is the best surviving detection's.

One narrow pass; memory for one block of texts.  Null and empty texts have no
words, no labels and score 0.  Repeated rows get equal results.  Columns other
than the two named ones are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.arrays import IS_ALNUM, Words, blocks, covered
from siftline.llm.frames import keyed_texts, longs, per_batch, table
from siftline.llm.license_rules import Rule, rules

#: Words on each side of a gate word that are searched.
REACH = 32

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<label:string,first_word:long,last_word:long,rule:long,score:double>>"
)


@cache
def compiled() -> tuple[np.ndarray, list[list[tuple[Rule, re.Pattern]]]]:
    """Hashes of the gate words in order, and each one's rules."""
    by_gate: dict[str, list[tuple[Rule, re.Pattern]]] = {}
    for rule in rules():
        by_gate.setdefault(rule.gate, []).append((rule, re.compile(f"(?<= ){rule.pattern}(?= )")))
    gates = sorted(by_gate)
    hashes = np.concatenate([Words(b, inside=IS_ALNUM).hash for b in blocks(pa.array(gates, pa.string()))])
    by = np.argsort(hashes)
    return hashes[by], [by_gate[gates[i]] for i in by]


def detect(words: list[str], gates: set[int]) -> list[tuple[Rule, int, int]]:
    """Every place where a rule of the given gates matches; words are numbered from 0, ends are exclusive."""
    text = " " + " ".join(words) + " "
    starts, at = [], 1
    for w in words:
        starts.append(at)
        at += len(w) + 1
    out = []
    for g in gates:
        for rule, pattern in compiled()[1][g]:
            for m in pattern.finditer(text):
                out.append((rule, bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1)))
    return out


def surviving(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Detections that no earlier rule's detection, nor a longer one of the same rule, contains."""
    kept: list[tuple[Rule, int, int]] = []
    begins: list[int] = []
    reach: list[int] = []
    for d in sorted(set(found), key=lambda d: (d[0].order, d[1] - d[2], d[1])):
        at = bisect_right(begins, d[1])
        if at and reach[at - 1] >= d[2]:
            continue
        kept.append(d)
        # begins stay sorted, reach holds the furthest end up to each begin
        begins.insert(at, d[1])
        reach.insert(at, max(d[2], reach[at - 1] if at else 0))
        for i in range(at + 1, len(reach)):
            if reach[i] >= d[2]:
                break
            reach[i] = d[2]
    return sorted(kept, key=lambda d: (d[1], d[2], d[0].order))


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: base phrases, labels, score and the surviving detections."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, _ = compiled()
        ids = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            words = Words(block, lower=True, inside=IS_ALNUM)
            n = len(words.hash)
            near = np.minimum(np.searchsorted(hashes, words.hash), len(hashes) - 1)
            gate_at = np.flatnonzero(hashes[near] == words.hash)
            owner = np.searchsorted(words.first, gate_at, "right") - 1
            lo = np.maximum(gate_at - REACH, words.first[owner])
            hi = np.minimum(gate_at + REACH + 1, words.first[owner + 1])
            found: list[list[tuple[Rule, int, int]]] = [[] for _ in range(len(block))]
            if len(gate_at):
                # overlapping surroundings of one text are one piece
                inside = covered(lo, hi, n)
                begin = inside.copy()
                begin[1:] &= ~inside[:-1]
                heads = words.first[:-1][words.first[:-1] < n]
                begin[heads] = inside[heads]
                piece = np.cumsum(begin) - 1
                starts = np.flatnonzero(begin)
                sizes = np.bincount(piece[inside], minlength=len(starts))
                gates: list[set[int]] = [set() for _ in starts]
                for p, g in zip(piece[gate_at].tolist(), near[gate_at].tolist(), strict=True):
                    gates[p].add(g)
                for p, (s, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
                    joined = [words.data[a:b].tobytes().decode() for a, b in zip(words.start[s : s + size], words.end[s : s + size], strict=True)]
                    doc = int(np.searchsorted(words.first, s, "right")) - 1
                    shift = s - int(words.first[doc])
                    found[doc] += [(r, a + shift, b + shift) for r, a, b in detect(joined, gates[p])]
            rows: dict[str, list] = {c: [] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            for each in found:
                base = [d for d in each if d[0].base]
                left = surviving(each)
                rows["n_base"].append(len(base))
                rows["first_word"].append(min((d[1] for d in base), default=None))
                rows["last_word"].append(max((d[1] for d in base), default=None))
                rows["base_labels"].append(",".join(sorted({d[0].label for d in base})))
                rows["labels"].append(",".join(sorted({d[0].label for d in [*base, *left]})))
                rows["score"].append(max((d[0].score for d in [*base, *left]), default=0.0))
                rows["detections"].append([{"label": r.label, "first_word": a, "last_word": b - 1, "rule": r.order, "score": r.score} for r, a, b in left])
            long, text_ = pa.int64(), pa.string()
            item = pa.struct([("label", text_), ("first_word", long), ("last_word", long), ("rule", long), ("score", pa.float64())])
            types = {"n_base": long, "first_word": long, "last_word": long, "base_labels": text_, "labels": text_, "score": pa.float64(), "detections": pa.list_(item)}
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids[block.rows], "n_words": longs(words.count)} | {c: pa.array(v, types[c]) for c, v in rows.items()}
            )

    return keyed_texts(docs, text, key).mapInArrow(per_batch(run), RESULT)


def op4_license_rules(spark, sf_dir: str) -> DataFrame:
    """License phrases and labels of every text of ``documents``."""
    return license_scan(table(spark, sf_dir, "documents"))

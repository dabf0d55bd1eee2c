"""Windowed co-occurrence patterns and context exclusions.

A pattern needs one term from each of its groups inside one window of the
text.  Matching is a narrow pass over positions (see ``rulepass``): no window
rows are exploded and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators.rulepass import attach_rules, exclusion_rules, in_groups, rule_blocks

LEVELS = ("sentence", "paragraph", "context3", "full")
FULL_WINDOW_GROUPS = 3
# Fixed value: what counts as a number inside a window.
NUMBER_REGEX = r"\d[\d,，.]*\s*(?:万亿|萬億|万|萬|亿|億)?"


@dataclass
class Signals:
    """SQL expressions that fill the groups which are not lists of terms."""

    amounts: str = "cast(array() AS array<string>)"
    reversals: str = "cast(array() AS array<string>)"
    entities: str = "cast(array() AS array<string>)"
    flag: str = "false"


@dataclass
class Pattern:
    pattern_id: str
    category: str
    base_score: float
    cap: float | None = None
    windows: tuple[str, ...] | None = None
    allow_full: bool = False
    full_limit: int | None = None
    groups: list[tuple[str, list[str]]] = field(default_factory=list)

    def levels(self) -> list[str]:
        """Windows to try, in order.  Without a list, the whole text is a last resort."""
        if self.windows is None:
            extra = ["full"] if len(self.groups) >= FULL_WINDOW_GROUPS else []
            return ["sentence", "paragraph", "context3"] + extra
        return [w for w in dict.fromkeys(self.windows) if w in LEVELS and (w != "full" or self.allow_full)]

    def score(self) -> float:
        return self.base_score if self.cap is None else min(self.base_score, self.cap)


def patterns_from_rows(rows: Iterable) -> list[Pattern]:
    """Assemble patterns from a rule_patterns table (one row per pattern, group and term).

    An optional column ``full_limit`` is the longest text, in characters, that
    counts as one window; without it there is no limit.
    """
    out: dict[str, Pattern] = {}
    groups: dict[tuple[str, int], tuple[str, list[str]]] = {}
    for r in sorted(rows, key=lambda r: (r.pattern_id, r.group_no, r.term_no)):
        out.setdefault(
            r.pattern_id,
            Pattern(
                r.pattern_id, r.category, r.base_score, r.cap, tuple(r.windows) if r.windows else None, bool(r.allow_full),
                r.full_limit if "full_limit" in r else None,
            ),
        )
        kind, terms = groups.setdefault((r.pattern_id, r.group_no), (r.group_kind or "term", []))
        if r.term:
            terms.append(r.term.lower())
    for (pattern_id, _), group in sorted(groups.items()):
        out[pattern_id].groups.append(group)
    return list(out.values())


def patterns_in(rule_patterns: DataFrame) -> Iterator[Pattern]:
    """The patterns of a table, by id, read as a stream."""
    for rows in in_groups(rule_patterns.orderBy("pattern_id", "group_no", "term_no").toLocalIterator(), "pattern_id"):
        yield from patterns_from_rows(rows)


def match_patterns(
    docs: DataFrame, rule_patterns: DataFrame, text: str = "text",
    signals: Signals = Signals(), ends: str = T.SENTENCE_ENDS, per_pass: int | None = None,
) -> DataFrame:
    """doc_id, pattern_id, category, score, level, window_no, matched_terms, snippet; at most one hit per pattern, best level first, then first window.

    Patterns are independent, so a pack of any size is handled in passes over
    blocks of about ``per_pass`` words of it.
    """
    found = attach_rules(
        docs, rule_blocks("patterns", patterns_in(rule_patterns), per_pass), text, patterns="_found", keep=["doc_id"], ends=ends,
        amounts=signals.amounts, reversals=signals.reversals, entities=signals.entities, flag=signals.flag,
    )
    return found.select("doc_id", F.explode("_found").alias("_item")).select("doc_id", "_item.*")


def text_windows(docs: DataFrame, text: str = "text", level: str = "sentence", ends: str = T.SENTENCE_ENDS) -> DataFrame:
    """Windows of one level as rows: doc_id, window_no, text."""
    texts = {
        "sentence": T.sentence_texts(text, ends),
        "paragraph": T.paragraph_texts(text),
        "context3": T.triples(T.sentence_texts(text, ends)),
        "full": f"array({text})",
    }[level]
    long = docs.select("doc_id", F.posexplode_outer(F.expr(texts)).alias("window_no", "text"))
    return long.filter("window_no IS NOT NULL")


def apply_context_exclusions(docs: DataFrame, rule_exclusions: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, term, total, kept for every excluding rule whose term occurs: its occurrences, and those without an excluding word nearby."""
    rules = rule_blocks("exclusions", exclusion_rules(rule_exclusions.toLocalIterator()))
    found = attach_rules(docs, rules, text, exclusions="_found", keep=["doc_id"])
    return found.select("doc_id", F.explode("_found").alias("_item")).select("doc_id", "_item.*")

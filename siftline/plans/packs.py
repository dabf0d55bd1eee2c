"""Rule packs: schemas, and a small neutral example pack.

A pack is a set of tables.  ``CompiledPack`` holds their rows, made once per
job; they go to the tasks as broadcast tables in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession

from siftline.operators.matcher import Exclusion, Surface
from siftline.operators.patterns import Pattern, patterns_from_rows
from siftline.operators.rows import rule_rows
from siftline.operators.rulepass import Negative, Rules, exclusion_rules, negative_rules, rule_blocks
from siftline.operators.terms import resolve_small

TERMS_SCHEMA = "term string, ktype string, category string, stage string, role string"
VARIANTS_SCHEMA = "variant string, canonical string"
PATTERNS_SCHEMA = (
    "pattern_id string, category string, group_no int, term_no int, term string, group_kind string,"
    " windows array<string>, allow_full boolean, base_score double, cap double"
)
NEGATIVES_SCHEMA = (
    "rule_id string, require array<string>, min_count int, also array<string>, forbid array<string>,"
    " forbid_types array<string>, flags array<string>, delta double, cap double"
)
EXCLUSIONS_SCHEMA = "term string, exclude_if array<string>, before int, after int"
CATEGORIES_SCHEMA = "category string, name string"
TASKS_SCHEMA = "category string, task_no int, task string"

DEMO_CATEGORIES = [("C01", "rude language"), ("C02", "licence notices"), ("C03", "credentials and contacts"), ("C04", "function words")]
DEMO_TERMS = [
    ("worthless", "H", "C01", "S1", "slot"), ("stupid", "H", "C01", "S1", "slot"), ("idiot", "H", "C01", "S1", "slot"),
    ("disgusting", "M", "C01", "", "slot"), ("trash", "M", "C01", "", "slot"), ("clown", "M", "C01", "", "slot"),
    ("license", "H", "C02", "S2", "slot"), ("released", "M", "C02", "", "slot"), ("version", "C", "C02", "", "slot"),
    ("apache", "S", "C02", "", "slot"), ("gnu", "S", "C02", "", "slot"),
    ("token", "E", "C03", "", "slot"), ("example.com", "E", "C03", "", "slot"),
    ("that", "C", "C04", "", "slot"), ("nicht", "C", "C04", "", "slot"), ("avec", "C", "C04", "", "slot"), ("para", "C", "C04", "", "slot"),
    ("token", "E", "GLOBAL", "", "evidence"), ("555-", "E", "GLOBAL", "", "evidence"), ("other", "X", "GLOBAL", "", "reversal"),
    ("then", "REPEAT", "GLOBAL", "", "boost"), ("there", "GROUP_IMPACT", "GLOBAL", "", "boost"), ("only", "FAILED", "GLOBAL", "", "boost"),
]
COMPLAINT_TERMS = [
    ("停电", "H", "G08", "", "slot"), ("停水", "H", "G08", "", "slot"), ("退件", "M", "G01", "", "slot"), ("补件", "M", "G01", "", "slot"), ("申请", "C", "G01", "", "slot"),
    ("worthless", "H", "C01", "", "slot"), ("stupid", "H", "C01", "", "slot"), ("license", "M", "C02", "", "slot"), ("that", "C", "C04", "", "slot"),
    ("公文", "E", "GLOBAL", "", "evidence"), ("token", "E", "GLOBAL", "", "evidence"), ("已解决", "X", "GLOBAL", "", "reversal"),
    ("反复", "REPEAT", "GLOBAL", "", "boost"), ("社区", "GROUP_IMPACT", "GLOBAL", "", "boost"), ("损坏", "LOSS", "GLOBAL", "", "boost"), ("仍未", "FAILED", "GLOBAL", "", "boost"),
]
COMPLAINT_PATTERNS = [
    ("GP05", "G08", 0, 0, "停电", "term", ["paragraph", "context3"], False, 84.0, None), ("GP05", "G08", 0, 1, "停水", "term", ["paragraph", "context3"], False, 84.0, None),
    ("GP05", "G08", 1, 0, "反复", "term", ["paragraph", "context3"], False, 84.0, None), ("GP05", "G08", 1, 1, "连续", "term", ["paragraph", "context3"], False, 84.0, None),
    ("GP02", "G01", 0, 0, "补件", "term", ["sentence"], False, 80.0, None), ("GP02", "G01", 1, 0, "退件", "term", ["sentence"], False, 80.0, None),
]
COMPLAINT_NEGATIVES = [("GN04", ["已解决"], 1, [], ["社区", "户"], [], [], -30.0, 45.0)]
DEMO_VARIANTS = [("licensed", "license"), ("hated", "disgusting"), ("this", "that")]
DEMO_PATTERNS = [
    ("P01", "C01", 0, 0, "worthless", "term", None, False, 80.0, None),
    ("P01", "C01", 0, 1, "stupid", "term", None, False, 80.0, None),
    ("P01", "C01", 1, 0, "that", "term", None, False, 80.0, None),
    ("P01", "C01", 1, 1, "with", "term", None, False, 80.0, None),
    ("P02", "C02|C04", 0, 0, "license", "term", ["sentence", "paragraph"], False, 72.0, 60.0),
    ("P02", "C02|C04", 1, 0, None, "amount", ["sentence", "paragraph"], False, 72.0, 60.0),
    ("P03", "C03", 0, 0, "token", "term", ["context3", "full"], True, 65.0, None),
    ("P03", "C03", 1, 0, "nicht", "term", ["context3", "full"], True, 65.0, None),
    ("P03", "C03", 1, 1, "avec", "term", ["context3", "full"], True, 65.0, None),
    ("P03", "C03", 1, 2, "that", "term", ["context3", "full"], True, 65.0, None),
    ("P04", "C04", 0, 0, "nicht", "term", None, False, 40.0, None),
    ("P04", "C04", 1, 0, "und", "term", None, False, 40.0, None),
    ("P04", "C04", 2, 0, None, "reversal", None, False, 40.0, None),
]
DEMO_NEGATIVES = [
    ("N01", ["worthless", "stupid", "idiot", "trash", "clown", "disgusting"], 2, [], ["license"], ["E"], [], -10.0, 70.0),
    ("N02", ["released", "version", "gnu"], 1, ["license"], [], ["H"], [], -5.0, None),
    ("N03", ["that"], 1, [], ["the"], [], [], -3.0, 30.0),
    ("N04", ["token"], 1, [], [], [], ["amounts"], 0.0, None),
]
DEMO_EXCLUSIONS = [("that", ["with", "from"], 25, 45), ("license", ["public"], 25, 45)]
DEMO_REVERSALS = ["other", "than"]
DEMO_TASKS = [
    ("C01", 0, "read the passage in context"), ("C01", 1, "check the speaker"),
    ("C02", 0, "find the licence text"), ("C02", 1, "check the version named"),
    ("C03", 0, "revoke the credential"), ("C03", 1, "check the speaker"),
]
DEMO_FALLBACK_TASKS = ["check the dates", "check the source"]


@dataclass
class RulePack:
    """The tables of a pack."""

    terms: DataFrame
    patterns: DataFrame
    negatives: DataFrame
    exclusions: DataFrame
    variants: DataFrame | None = None
    categories: DataFrame | None = None
    reversals: list[str] = field(default_factory=list)

    def compile(self) -> "CompiledPack":
        terms = rule_rows(self.terms)
        variants = rule_rows(self.variants) if self.variants is not None else []

        def of_role(role: str, spellings=()) -> list[Surface]:
            return resolve_small((t for t in terms if t.role == role), spellings)

        return CompiledPack(
            terms=of_role("slot", variants),
            evidence=of_role("evidence"),
            reversal_terms=of_role("reversal"),
            boosts=of_role("boost"),
            patterns=patterns_from_rows(rule_rows(self.patterns)),
            negatives=list(negative_rules(sorted(rule_rows(self.negatives), key=lambda r: r.rule_id))),
            exclusions=list(exclusion_rules(rule_rows(self.exclusions))),
            reversals=list(self.reversals),
        )


@dataclass(frozen=True)
class CompiledPack:
    terms: list[Surface]
    patterns: list[Pattern]
    negatives: list[Negative]
    exclusions: list[Exclusion]
    evidence: list[Surface]
    reversal_terms: list[Surface]
    boosts: list[Surface]
    reversals: list[str]

    def blocks(self) -> Iterator[Rules]:
        """Patterns and negative rules together, in blocks of bounded size."""
        nothing = Rules()
        for a, b in zip_longest(rule_blocks("patterns", self.patterns), rule_blocks("negatives", self.negatives), fillvalue=nothing):
            yield Rules(patterns=a.patterns, negatives=b.negatives)


def demo_pack(spark: SparkSession) -> RulePack:
    def table(rows, schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema).coalesce(1)

    return RulePack(
        terms=table(DEMO_TERMS, TERMS_SCHEMA),
        patterns=table(DEMO_PATTERNS, PATTERNS_SCHEMA),
        negatives=table(DEMO_NEGATIVES, NEGATIVES_SCHEMA),
        exclusions=table(DEMO_EXCLUSIONS, EXCLUSIONS_SCHEMA),
        variants=table(DEMO_VARIANTS, VARIANTS_SCHEMA),
        categories=table(DEMO_CATEGORIES, CATEGORIES_SCHEMA),
        reversals=DEMO_REVERSALS,
    )


def demo_complaint_pack(spark: SparkSession) -> RulePack:
    def table(rows, schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema).coalesce(1)

    return RulePack(
        terms=table(COMPLAINT_TERMS, TERMS_SCHEMA),
        patterns=table(COMPLAINT_PATTERNS, PATTERNS_SCHEMA),
        negatives=table(COMPLAINT_NEGATIVES, NEGATIVES_SCHEMA),
        exclusions=spark.createDataFrame([], EXCLUSIONS_SCHEMA),
    )

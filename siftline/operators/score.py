"""Categories, rule score, score dimensions and the complaint score.

Hits stay in the document's row as arrays, so scoring is arithmetic over one
row and never shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import scoring as S
from siftline.functions.sql import let, quote, string_array
from siftline.operators.rows import rule_rows

# Fixed values of the rule score.
TYPE_WEIGHT = {"H": 14.0, "M": 6.0, "C": 2.0, "E": 8.0, "S": 5.0}
TYPE_CAP = {"H": 60.0, "M": 35.0, "C": 20.0, "E": 40.0, "S": 25.0}
PATTERN_SHARE = 0.6
GENERIC_CATEGORY = "GLOBAL"


def type_score(hits: str, ktype: str) -> str:
    """Weight of one hit type: full for the first mention, a fifth more for the second and third."""
    weight = quote(TYPE_WEIGHT[ktype])
    total = (
        f"aggregate(filter({hits}, _h -> _h.ktype = '{ktype}'), 0D, (_a, _h) -> _a + {weight}"
        " * (1D + 0.2D * (least(greatest(_h.count, 1), 3) - 1)))"
    )
    return f"least({quote(TYPE_CAP[ktype])}, {total})"


def count_type(hits: str, ktype: str) -> str:
    return f"size(filter({hits}, _h -> _h.ktype = '{ktype}'))"


def pattern_score(patterns: str) -> str:
    """Best pattern per category, each at its share; a pattern may name several categories."""
    pairs = f"flatten(transform({patterns}, _p -> transform(split(_p.category, '[|]'), _c -> named_struct('c', _c, 's', _p.score))))"
    best = "array_max(transform(filter(_q, _y -> _y.c = _c), _y -> _y.s))"
    return let("_q", pairs, f"aggregate(array_distinct(transform(_q, _x -> _x.c)), 0D, (_a, _c) -> _a + {best} * {PATTERN_SHARE}D)")


def rule_score(hits: str, patterns: str, n_amounts: str, has_target: str, delta: str, cap: str) -> str:
    """0 or more: typed hits, patterns, boosts, then negatives and their cap."""
    n_e, n_m, n_c = (count_type("_h0", t) for t in "EMC")
    parts = [type_score("_h0", t) for t in TYPE_WEIGHT]
    parts += [
        pattern_score("_p0"),
        f"CASE WHEN {n_e} >= 3 THEN 4D ELSE 0D END",
        f"least(8D, 2D * ({n_amounts}))",
        f"CASE WHEN {has_target} AND ({n_amounts}) > 0 AND {n_e} >= 1 THEN 5D ELSE 0D END",
        f"CASE WHEN {n_m} >= 2 AND {n_c} >= 1 AND {n_e} >= 1 AND size(_p0) = 0"
        f" THEN least(30D, 12D + 4D * ({n_m} - 2) + 3D * least({n_e}, 3)) ELSE 0D END",
        f"CASE WHEN {n_m} >= 3 AND {n_c} >= 2 THEN 8D ELSE 0D END",
        f"coalesce({delta}, 0D)",
    ]
    total = f"least({' + '.join(parts)}, coalesce({cap}, 1e9D))"
    return let("_h0", hits, let("_p0", patterns, f"greatest(0D, round({total}, 2))"))


def ranked_categories(hits: str, types: Iterable[str]) -> str:
    """Categories of some hit types, most hits first, then by name."""
    mine = f"filter({hits}, _h -> array_contains({string_array(types)}, _h.ktype) AND _h.category <> '' AND _h.category <> '{GENERIC_CATEGORY}')"
    sums = (
        "transform(array_distinct(transform(_k, _h -> _h.category)), _c -> named_struct('n',"
        " -aggregate(filter(_k, _h -> _h.category = _c), 0L, (_a, _h) -> _a + _h.count), 'c', _c))"
    )
    return let("_k", mine, f"transform(array_sort({sums}), _x -> _x.c)")


def assign_categories(hits: str, patterns: str) -> str:
    """array<string>: pattern categories first, then what the hits support.

    With patterns, hit categories only confirm.  Without, categories of
    strong hits are taken, then others while fewer than three; failing all,
    the two best context categories.
    """
    pattern_cats = (
        f"array_sort(array_distinct(filter(flatten(transform({patterns}, _p -> split(_p.category, '[|]'))),"
        f" _c -> _c <> '{GENERIC_CATEGORY}')))"
    )
    # categories of context terms that took part in a pattern belong to it
    context = (
        f"array_distinct(transform(filter({hits}, _h -> _h.ktype = 'C' AND _h.category <> '{GENERIC_CATEGORY}'"
        f" AND exists({patterns}, _p -> array_contains(_p.matched_terms, _h.surface))), _h -> _h.category))"
    )
    with_patterns = f"array_sort(array_union({pattern_cats}, {context}))"
    strong = ranked_categories(hits, ["H"])
    fill = f"concat(_s, slice(array_except({ranked_categories(hits, ['M', 'E'])}, _s), 1, greatest(3 - size(_s), 0)))"
    without = let("_s", strong, fill)
    fallback = f"slice({ranked_categories(hits, ['C'])}, 1, 2)"
    first = f"CASE WHEN size({patterns}) > 0 THEN {with_patterns} ELSE {without} END"
    return let("_f", first, f"CASE WHEN size(_f) > 0 THEN _f ELSE {fallback} END")


@dataclass(frozen=True)
class Dimension:
    """One bounded score dimension: points of every predicate that holds, up to ``most``."""

    name: str
    most: float
    rules: tuple[tuple[str, float], ...]
    base: float = 0.0


def dimension_value(d: Dimension) -> str:
    parts = [quote(d.base)] + [f"CASE WHEN {p} THEN {quote(float(v))} ELSE 0D END" for p, v in d.rules]
    return f"least({quote(float(d.most))}, {' + '.join(parts)})"


def score_dimensions(docs: DataFrame, dimensions: Iterable[Dimension], keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """doc_id, dimensions (map) and total; the rules are SQL predicates over the columns of ``docs``."""
    dims = list(dimensions)
    pairs = ", ".join(f"{quote(d.name)}, round({dimension_value(d)}, 1)" for d in dims)
    out = docs.select(*keep, F.expr(f"map({pairs})").alias("dimensions"))
    return out.withColumn("total", F.expr("round(aggregate(map_values(dimensions), 0D, (_a, _v) -> _a + _v), 1)"))


@dataclass(frozen=True)
class Bonus:
    """Points added to the complaint total when a predicate holds."""

    name: str
    predicate: str
    points: float


# Bonus points of the complaint score.  The predicates use the
# columns made by ``complaint_dimensions``.
COMPLAINT_BONUSES = (
    Bonus("lasting_and_shared", "n_h > 0 AND duration >= 6 AND group_impact >= 7", 6),
    Bonus("reported_without_effect", "failed_remedy >= 6 AND array_contains(marks, 'unresolved')", 8),
    Bonus("wrong_decision_with_loss", "array_contains(marks, 'wrong_decision') AND (array_contains(marks, 'give_back') OR loss >= 7)", 6),
    Bonus("public_safety", "array_contains(marks, 'safety') AND (severity >= 14 OR public_interest >= 7)", 4),
    Bonus("dated_proof", "has_attachment AND array_contains(marks, 'dated_proof')", 4),
    Bonus("two_strong_patterns", "n_strong_patterns >= 2", 3),
    Bonus("scarce_places", "array_contains(marks, 'places') AND duration >= 10 AND group_impact >= 9", 10),
    Bonus("scarce_housing", "array_contains(marks, 'housing') AND group_impact >= 12", 14),
    Bonus("care_crisis", "array_contains(marks, 'care') AND group_impact >= 9", 20),
    Bonus("deadline_for_many", "array_contains(marks, 'deadline') AND group_impact >= 9", 8),
    Bonus("policy_gap", "array_contains(marks, 'policy_gap') AND group_impact >= 9", 16),
    Bonus("reclaim_after_error", "array_contains(marks, 'error') AND array_contains(marks, 'forced_back') AND loss >= 7", 24),
    Bonus("failing_service", "array_contains(pattern_marks, 'outage') AND n_repeat > 0", 12),
    Bonus("late_warning", "array_contains(marks, 'disaster') AND array_contains(marks, 'late_warning') AND group_impact >= 9", 16),
    Bonus("paper_chase", "array_contains(pattern_marks, 'resubmission') AND array_contains(pattern_marks, 'ignored')", 6),
    Bonus("refused_report", "array_contains(marks, 'refused') AND array_contains(marks, 'fraud')", 14),
    Bonus("reclaim_pattern_with_loss", "array_contains(pattern_marks, 'reclaim') AND loss >= 7", 2),
)


def complaint_dimensions(docs: DataFrame) -> DataFrame:
    """Seven bounded dimensions from hit counts and measured quantities.

    Expects: n_h, n_m, n_e, n_repeat, n_group, n_loss, n_failed (hit counts),
    duration_days, approximate_days, population, population_confidence,
    money_loss, waiting_days, frequency, complaint_count, deadline (measures),
    has_attachment, marks and pattern_marks (arrays of marker names),
    n_patterns, n_strong_patterns.
    """

    def most(*parts: str) -> str:
        return f"greatest({', '.join(parts)})"

    def when(predicate: str, points: float) -> str:
        return f"CASE WHEN {predicate} THEN {quote(float(points))} ELSE 0D END"

    def marked(name: str, column: str = "marks") -> str:
        return f"array_contains({column}, '{name}')"

    severity = most(
        "4D", when("n_h >= 1", 12), when("n_h >= 2", 15), when("n_h >= 3", 17), when(marked("severe"), 16),
        when(marked("severe", "pattern_marks"), 17), when(marked("care"), 18),
        when(f"{marked('refused')} AND {marked('fraud')}", 20),
    )
    duration = most(
        "CASE WHEN n_repeat > 0 THEN 8D + least(4D, n_repeat * 1.5D) ELSE 0D END", when(marked("lasting"), 6),
        when(marked("long_lasting"), 10), when(marked("lasting", "pattern_marks"), 11), when(marked("again"), 9),
        "CASE WHEN duration_days >= 180 THEN 11D WHEN duration_days >= 30 THEN 9D WHEN duration_days >= 7 THEN 7D"
        " WHEN duration_days > 0 THEN 6D ELSE 0D END",
        when("approximate_days > 0", 8),
    )
    group = most(
        "CASE WHEN n_group > 0 THEN 7D + least(5D, n_group * 1.2D) ELSE 0D END", when(marked("many"), 9),
        when(marked("very_many"), 12), when(marked("severe_group", "pattern_marks"), 12),
        "CASE WHEN population >= 1000 THEN 12D WHEN population >= 100 THEN 9D WHEN population > 0 THEN 7D ELSE 0D END",
        when("population_confidence >= 0.8 AND population >= 100", 10),
    )
    loss = most(
        "CASE WHEN n_loss > 0 THEN 7D + least(5D, n_loss * 1.5D) ELSE 0D END", when(marked("money"), 9),
        when(marked("damage"), 8), when(marked("fraud_loss"), 12),
        "CASE WHEN money_loss >= 100000 THEN 11D WHEN money_loss >= 10000 THEN 9D WHEN money_loss > 0 THEN 7D ELSE 0D END",
        when("waiting_days >= 7", 8),
    )
    evidence = most(
        "2D", "CASE WHEN n_e > 0 THEN 6D + least(6D, n_e * 1.5D) ELSE 0D END", when("has_attachment", 9),
        when(marked("proof"), 8), when("n_e >= 3 OR (has_attachment AND n_e > 0)", 12),
        when(f"{marked('approved')} AND {marked('reclaim')}", 12),
    )
    failed = most(
        "CASE WHEN n_failed > 0 THEN 5D + least(3D, n_failed * 1D) ELSE 0D END", when(marked("ignored", "pattern_marks"), 8),
        when(marked("reported"), 6), "CASE WHEN frequency >= 5 THEN 7D WHEN frequency >= 2 THEN 6D ELSE 0D END",
        "CASE WHEN complaint_count > 0 THEN least(8D, 4D + complaint_count) ELSE 0D END",
    )
    crime = f"({marked('refused')} AND {marked('fraud')})"
    first = docs.select(
        "*",
        F.expr(f"least(20D, {severity})").alias("severity"),
        F.expr(f"least(15D, {duration})").alias("_duration"),
        F.expr(f"least(15D, {group})").alias("_group"),
        F.expr(f"least(15D, {loss})").alias("_loss"),
        F.expr(f"least(15D, {evidence})").alias("evidence"),
        F.expr(f"least(10D, {failed})").alias("failed_remedy"),
    )
    public = most(
        "3D", when(f"_group >= 9 OR {marked('very_many')}", 8), when(marked("public"), 7),
        when(f"_group >= 12 OR {marked('severe_group', 'pattern_marks')}", 9), when(marked("public_category"), 7),
        when("population >= 100", 8), when("deadline AND population >= 100", 9),
    )
    # a crisis that touches several people, or a refused report of a fraud, lifts more than one dimension
    shared_care = f"({marked('care')} AND ({marked('several')} OR _group >= 9))"
    second = first.select(
        "*",
        F.expr(most("_group", when(shared_care, 12))).alias("group_impact"),
        F.expr(most("_loss", when(crime, 13))).alias("loss"),
        F.expr(most(f"least(10D, {public})", when(shared_care, 10), when(crime, 9))).alias("public_interest"),
    )
    systemic = f"({marked('policy_gap')} OR ({marked('disaster')} AND {marked('late_warning')})) AND group_impact >= 9"
    lasting = most("_duration", when(marked("care"), 8), when(crime, 9), when(systemic, 8))
    return second.withColumn("duration", F.expr(lasting)).drop("_duration", "_group", "_loss")


def complaint_score(docs: DataFrame, bonuses: Iterable[Bonus] = COMPLAINT_BONUSES) -> DataFrame:
    """Complaint total 0-100 with band, from ``complaint_dimensions`` plus delta and cap of negatives."""
    dims = ("severity", "duration", "group_impact", "loss", "evidence", "failed_remedy", "public_interest")
    bonus = " + ".join(f"CASE WHEN {b.predicate} THEN {quote(float(b.points))} ELSE 0D END" for b in bonuses)
    summed = complaint_dimensions(docs).withColumn("bonus", F.expr(bonus))
    total = " + ".join(f"round({d}, 1)" for d in dims) + " + bonus"
    weak = (
        "CASE WHEN n_h = 0 AND n_patterns = 0 THEN CASE WHEN n_m <= 1 AND n_e = 0 AND group_impact < 7 THEN 38D ELSE 55D END"
        " ELSE 1000D END"
    )
    single = (
        "CASE WHEN group_impact < 7 AND duration < 6 AND loss < 7 AND failed_remedy < 6 AND _t0 > 68"
        " THEN CASE WHEN n_e > 0 OR n_h > 0 THEN 68D ELSE 55D END ELSE 1000D END"
    )
    explained = "CASE WHEN array_contains(marks, 'explained') THEN 45D ELSE 1000D END"
    floored = "CASE WHEN n_h > 0 AND duration >= 6 AND _t1 < 40 THEN 40D ELSE _t1 END"
    staged = (
        summed.withColumn("_t0", F.expr(f"least({total}, {weak})"))
        .withColumn("_t1", F.expr(f"least(_t0, {single}, {explained})"))
        .withColumn("_t2", F.expr(floored))
    )
    final = "greatest(0D, least(100D, rint(least(_t2 + coalesce(delta, 0D), coalesce(cap, 1000D)))))"
    # nothing to go by at all: no score, whatever the arithmetic says
    final = f"CASE WHEN n_h = 0 AND n_m = 0 AND n_patterns = 0 THEN 0D ELSE {final} END"
    return (
        staged.withColumn("complaint_score", F.expr(final))
        .withColumn("complaint_band", F.expr(S.band("complaint_score")))
        .drop("_t0", "_t1", "_t2")
    )


def final_score(total: str, stage_delta: str, delta: str, cap: str) -> str:
    """Whole number 0-100 after stage, negatives and caps."""
    return f"greatest(0D, least(100D, rint(least({total} + {stage_delta} + coalesce({delta}, 0D), {cap}))))"


def verification_checklist(docs: DataFrame, tasks: DataFrame, fallback: list[str], limit: int | None = None) -> DataFrame:
    """doc_id, tasks: what to check for a document's categories, in category and task order.

    docs: doc_id, categories.  tasks: category, task_no, task (a rule table).
    ``limit`` shortens a list for display.
    """
    by_category: dict[str, list[str]] = {}
    for r in sorted(rule_rows(tasks), key=lambda r: (r.category, r.task_no)):
        by_category.setdefault(r.category, []).append(r.task)
    pairs = ", ".join(f"{quote(c)}, {string_array(ts)}" for c, ts in sorted(by_category.items()))
    found = f"array_distinct(flatten(transform(categories, _c -> coalesce(map({pairs})[_c], cast(array() AS array<string>)))))"
    chosen = let("_f", found, f"CASE WHEN size(_f) > 0 THEN _f ELSE {string_array(fallback)} END")
    return docs.select("doc_id", F.expr(chosen if limit is None else f"slice({chosen}, 1, {limit})").alias("tasks"))


def escalation(rule_score_sql: str, patterns: str, has_evidence: str, has_entity: str, has_amount: str, threshold: float = 60.0) -> str:
    """Why a document deserves a second look, or NULL."""
    return (
        f"CASE WHEN {rule_score_sql} >= {quote(threshold)} THEN 'SCORE'"
        f" WHEN exists({patterns}, _p -> _p.score >= 70D) THEN 'PATTERN'"
        f" WHEN {has_evidence} AND {has_entity} AND {has_amount} THEN 'EVIDENCE_ENTITY_AMOUNT' END"
    )

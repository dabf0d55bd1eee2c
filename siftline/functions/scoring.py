"""Bands, tracks, caps and fused scores as SQL expressions."""

from __future__ import annotations

from siftline.functions.sql import quote

# Fixed values.
BAND_FLOORS = {"S": 90.0, "A": 75.0, "B": 60.0, "C": 40.0, "D": 0.0}
BAND_RANK = {"S": 5, "A": 4, "B": 3, "C": 2, "D": 1}
STAGE_DELTA = {"E0": -20.0, "E1": 0.0, "E2": 5.0, "E3": 8.0, "E4": 10.0, "E5": 12.0, "EX": -25.0}
REVERSED_WITH_NEWS_DELTA = -8.0
GATES = [(45.0, 38.0), (70.0, 65.0), (90.0, 80.0)]  # rule score below -> final score at most
SHAPE_OF_TYPE = {
    "pdf": "OFFICIAL_DOCUMENT", "docx": "INTERNAL_DOCUMENT", "xlsx": "SPREADSHEET", "xls": "SPREADSHEET",
    "csv": "SPREADSHEET", "jpg": "PHOTO", "jpeg": "PHOTO", "png": "PHOTO", "eml": "INTERNAL_DOCUMENT",
    "txt": "OFFICIAL_DOCUMENT",
}
FIRST, SECOND, MIXED, NONE = "FIRST", "SECOND", "MIXED", "NONE"
ACTIVE_AT, STRONG_AT, MIXED_BONUS = 40.0, 60.0, 5.0


def band(score: str) -> str:
    whens = " ".join(f"WHEN {score} >= {quote(f)} THEN {quote(b)}" for b, f in BAND_FLOORS.items() if f > 0)
    return f"CASE {whens} ELSE 'D' END"


def band_rank(band_sql: str) -> str:
    whens = " ".join(f"WHEN {quote(b)} THEN {r}" for b, r in BAND_RANK.items() if r > 1)
    return f"CASE {band_sql} {whens} ELSE 1 END"


def stage_adjust(stage: str, has_new_evidence: str) -> str:
    """Points for the evidence stage; a reversed matter with new evidence is only eased down."""
    whens = " ".join(f"WHEN {quote(s)} THEN {quote(d)}" for s, d in STAGE_DELTA.items())
    return (
        f"CASE WHEN {stage} = 'EX' AND {has_new_evidence} THEN {quote(REVERSED_WITH_NEWS_DELTA)}"
        f" ELSE CASE {stage} {whens} ELSE 0D END END"
    )


def signal_gate_cap(rule_score: str, *other_caps: str) -> str:
    """Highest final score that a rule score allows, lowered by any other caps that apply."""
    whens = " ".join(f"WHEN {rule_score} < {quote(below)} THEN {quote(cap)}" for below, cap in GATES)
    gate = f"CASE {whens} ELSE 100D END"
    return f"least({', '.join([gate, *other_caps])})" if other_caps else gate


def is_active(categories: str, score: str, at: float = ACTIVE_AT) -> str:
    return f"(size({categories}) > 0 AND {score} >= {quote(at)})"


def assign_track(cats_a: str, score_a: str, cats_b: str, score_b: str) -> str:
    a, b = is_active(cats_a, score_a), is_active(cats_b, score_b)
    return f"CASE WHEN {a} AND {b} THEN '{MIXED}' WHEN {a} THEN '{FIRST}' WHEN {b} THEN '{SECOND}' ELSE '{NONE}' END"


def secondary_track(track: str, cats_a: str, cats_b: str) -> str:
    return (
        f"CASE WHEN {track} = '{FIRST}' AND size({cats_b}) > 0 THEN '{SECOND}'"
        f" WHEN {track} = '{SECOND}' AND size({cats_a}) > 0 THEN '{FIRST}' ELSE '' END"
    )


def track_confidence(track: str, score_a: str, score_b: str) -> str:
    strong = (
        f"(CASE WHEN {score_a} >= {quote(STRONG_AT)} THEN 0.05D ELSE 0D END)"
        f" + (CASE WHEN {score_b} >= {quote(STRONG_AT)} THEN 0.05D ELSE 0D END)"
    )
    return (
        f"CASE {track} WHEN '{NONE}' THEN 0D"
        f" WHEN '{MIXED}' THEN round(least(1D, ({score_a} + {score_b}) / 200D + 0.1D + {strong}), 2)"
        f" ELSE round(least(1D, greatest({score_a}, {score_b}) / 100D), 2) END"
    )


def fuse_scores(cats_a: str, score_a: str, cats_b: str, score_b: str) -> str:
    """Higher of two scores, with a bonus when both tracks are active."""
    a, b = is_active(cats_a, score_a), is_active(cats_b, score_b)
    bound = "greatest(0D, least(100D, {}))"
    best = f"greatest({bound.format(score_a)}, {bound.format(score_b)})"
    return f"round(least(100D, {best} + CASE WHEN {a} AND {b} THEN {quote(MIXED_BONUS)} ELSE 0D END), 1)"


def fused_band(cats_a: str, score_a: str, band_a: str, cats_b: str, score_b: str, band_b: str, fused: str) -> str:
    """Band of the fused score; a track active on its own passes its own band on."""
    a, b = is_active(cats_a, score_a), is_active(cats_b, score_b)
    return (
        f"CASE WHEN {a} AND NOT {b} AND {band_a} <> '' THEN {band_a}"
        f" WHEN {b} AND NOT {a} AND {band_b} <> '' THEN {band_b} ELSE {band(fused)} END"
    )


def novelty_score(known: str, has_amount: str, has_evidence: str, no_new: str, oldish: str) -> str:
    """10 for news, 5 for a known matter with something new, 0 for a repeat."""
    return (
        f"CASE WHEN {known} THEN CASE WHEN {has_amount} OR {has_evidence} THEN 5D ELSE 0D END"
        f" WHEN {no_new} THEN 0D"
        f" WHEN {oldish} AND NOT {has_amount} THEN CASE WHEN {has_evidence} THEN 5D ELSE 0D END"
        " ELSE 10D END"
    )


def evidence_shapes(file_types: str, has_evidence: str) -> str:
    """Distinct kinds of material among the attached file types, plus a flag for named evidence."""
    pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in SHAPE_OF_TYPE.items())
    shapes = f"filter(transform({file_types}, _t -> map({pairs})[lower(_t)]), _s -> _s IS NOT NULL)"
    extra = f"CASE WHEN {has_evidence} THEN array('MULTI_SOURCE_PACKAGE') ELSE cast(array() AS array<string>) END"
    return f"array_distinct(concat({shapes}, {extra}))"


def risk_flags(negative_ids: str, categories: str) -> str:
    return f"array_distinct(filter(concat({negative_ids}, {categories}), _f -> _f <> ''))"

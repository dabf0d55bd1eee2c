"""Two-track triage: the rule track and the complaint track of every document, fused into one record.

Like the single track, this is one narrow job: every document is scored in
its own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import scoring as S
from siftline.functions.privacy import hash_ref
from siftline.functions.text import fit
from siftline.operators.complaints import complaint_measures
from siftline.operators.matcher import attach_hits
from siftline.operators.rulepass import attach_rules
from siftline.operators.score import complaint_score
from siftline.operators.terms import SLOT_RADIUS, slotted_sql
from siftline.plans.packs import CompiledPack
from siftline.plans.triage import prepare, triage

NOTHING = "cast(array() AS array<string>)"


def complaint_triage(
    docs: DataFrame, pack: CompiledPack, text: str = "text", has_attachment: str = "false",
    pattern_marks: dict | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, complaint score and band, categories, measures and marks.

    A column ``norm`` with the matching form of the text is used if there.
    """
    staged = docs if "norm" in docs.columns else prepare(docs, text)
    staged = staged.withColumn("has_attachment", F.expr(has_attachment))
    found = {"_slots": pack.terms, "_evidence": pack.evidence, "_reversal": pack.reversal_terms, "_boosts": pack.boosts}
    staged = attach_hits(staged, found, "norm", SLOT_RADIUS)
    staged = staged.withColumn("hits", F.expr(slotted_sql("norm", *found))).drop(*found)
    types = "array_distinct(transform(hits, _h -> _h.ktype))"
    staged = attach_rules(staged, pack.blocks(), "norm", patterns="patterns", negatives="negatives", types=types)
    staged = staged.select(
        "*",
        F.expr("aggregate(negatives, 0D, (_a, _n) -> _a + _n.delta)").alias("delta"),
        F.expr("array_min(transform(negatives, _n -> _n.cap))").alias("cap"),
    )
    scored = complaint_score(complaint_measures(staged, "norm", pattern_marks))
    return scored.select(
        "doc_id", "complaint_score", "complaint_band", "categories", "hits", "patterns", "negatives", "marks", "duration_days", "approximate_days",
        "population", "frequency", "complaint_count", "money_loss", "waiting_days", "severity", "duration", "group_impact", "loss", "evidence",
        "failed_remedy", "public_interest", "bonus", *keep,
    )


def complaint_summary(limit: int = 220) -> str:
    """Short summary of a complaint from its measures."""
    parts = [
        "concat('complaint(', array_join(slice(complaint_categories, 1, 4), '、'), ')')",
        "CASE WHEN duration_days IS NOT NULL THEN concat('lasting:', format_number(duration_days, 0), 'd')"
        " WHEN approximate_days IS NOT NULL THEN 'lasting:long' END",
        "CASE WHEN population > 0 THEN concat('affected:', format_number(population, 0)) END",
        "CASE WHEN greatest(frequency, complaint_count) > 0 THEN concat('reports:', format_number(greatest(frequency, complaint_count), 0)) END",
        "CASE WHEN money_loss > 0 THEN concat('loss:', format_number(money_loss, 0)) END",
        "CASE WHEN waiting_days > 0 THEN concat('waiting:', format_number(waiting_days, 0), 'd') END",
        "concat('score:', format_number(score, 0), '/', band, '。')",
    ]
    return fit(f"concat_ws('，', {', '.join(parts)})", limit)


def two_track_records(docs: DataFrame, first: CompiledPack, second: CompiledPack, text: str = "text", has_attachment: str = "false") -> DataFrame:
    """One record per document: both scores, track, confidence, fused score and band, flags and summary.

    The second track goes on from the row in which the first has left its
    results, so the text is read and normalised once and nothing is joined.
    """
    kept = ("norm",)
    if has_attachment != "false":
        docs = docs.withColumn("_attached", F.expr(has_attachment))
        kept += ("_attached",)
    a = triage(docs, first, text, kept).select(
        "doc_id", F.col("score").alias("first_score"), F.col("band").alias("first_band"), F.col("categories").alias("first_categories"),
        F.expr("transform(patterns, _p -> _p.pattern_id)").alias("first_patterns"), F.expr("transform(negatives, _n -> _n.rule_id)").alias("first_negatives"),
        F.expr("n_e > 0").alias("has_evidence"), F.col("summary").alias("first_summary"), *kept,
    )
    results = tuple(c for c in a.columns if c.startswith("first_")) + ("has_evidence",)
    joined = complaint_triage(a, second, "norm", "_attached" if "_attached" in kept else "false", keep=results).select(
        "doc_id", F.col("complaint_score").alias("second_score"), F.col("complaint_band").alias("second_band"), F.col("categories").alias("complaint_categories"),
        F.expr("transform(patterns, _p -> _p.pattern_id)").alias("second_patterns"), F.expr("transform(negatives, _n -> _n.rule_id)").alias("second_negatives"),
        "duration_days", "approximate_days", "population", "frequency", "complaint_count", "money_loss", "waiting_days", *results,
    )
    sides = ("first_categories", "first_score", "complaint_categories", "second_score")
    out = joined.withColumn("track", F.expr(S.assign_track(*sides)))
    out = out.select(
        "*",
        F.expr(S.secondary_track("track", "first_categories", "complaint_categories")).alias("second_track"),
        F.expr(S.track_confidence("track", "first_score", "second_score")).alias("confidence"),
        F.expr(S.fuse_scores(*sides)).alias("score"),
    )
    out = out.withColumn(
        "band", F.expr(S.fused_band("first_categories", "first_score", "first_band", "complaint_categories", "second_score", "second_band", "score"))
    )
    flags = S.risk_flags("concat(first_negatives, second_negatives)", "complaint_categories")
    summary = f"CASE WHEN track IN ('{S.SECOND}', '{S.MIXED}') THEN {complaint_summary()} ELSE first_summary END"
    return out.select(
        "doc_id", F.expr(hash_ref("cast(doc_id AS string)")).alias("ref"), "first_score", "second_score", "track", "second_track", "confidence", "score", "band",
        "first_categories", "complaint_categories", F.expr("array_union(first_patterns, second_patterns)").alias("patterns"),
        F.expr(flags).alias("risk_flags"), F.expr(S.evidence_shapes(NOTHING, "has_evidence")).alias("evidence_shapes"), F.expr(summary).alias("summary"),
    )

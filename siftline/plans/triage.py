"""The whole triage of a table of documents as one narrow job.

Every step adds columns to the document's own row: no shuffle, one scan, one
Arrow pass that finds all terms and one for the rules that need what was
found.  The cost grows with the amount of text and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import numbers as N
from siftline.functions import scoring as S
from siftline.functions import text as T
from siftline.functions.sql import any_contains, string_array
from siftline.operators import score as A
from siftline.operators.extract import summary_sql
from siftline.operators.matcher import attach_hits
from siftline.operators.negatives import RECEIPT_CAP, no_new_information
from siftline.operators.rulepass import attach_rules
from siftline.plans.packs import CompiledPack

# Words by which a text says that it repeats old news.
REPOST_MARKERS = (
    "转发", "轉發", "转寄", "轉寄", "转贴", "轉貼", "转载", "轉載", "旧闻", "舊聞", "当年新闻", "當年新聞",
    "去年报道", "去年報導", "旧新闻", "舊新聞", "旧案", "舊案",
)
# Bounded dimensions of the final score, over the columns of ``signals``.
DIMENSIONS = (
    A.Dimension("severity", 20.0, (("n_h >= 1", 12.0), ("n_h >= 2", 3.0), ("n_h >= 3", 2.0), ("size(patterns) > 0", 3.0))),
    A.Dimension("evidence", 20.0, (("n_e >= 1", 8.0), ("n_e >= 3", 4.0), ("size(amounts) > 0", 4.0)), base=2.0),
    A.Dimension("context", 15.0, (("n_c >= 1", 8.0), ("n_c >= 2", 4.0), ("size(categories) >= 2", 3.0))),
    A.Dimension("novelty", 10.0, (("novelty >= 5", 5.0), ("novelty >= 10", 5.0))),
    A.Dimension("strength", 35.0, (("rule_score >= 45", 10.0), ("rule_score >= 70", 10.0), ("rule_score >= 90", 15.0))),
)


def prepare(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with the matching form of their text, line breaks kept for window splitting."""
    return docs.withColumn("norm", F.expr(T.normalize_text(text, keep_newlines=True)))


@dataclass(frozen=True)
class Context:
    """What is known of a document from elsewhere, as SQL expressions over its columns.

    ``known``: it repeats a known case (see ``known_case_match``).  ``stage``:
    the stage of its evidence.  ``target``: it names a listed party.
    ``entities``: an array of the names that fill ``entity`` groups.  ``bulk``:
    it is a receipt, a notice or an advertisement, whose score is capped.
    """

    known: str = "false"
    stage: str = "''"
    target: str = "false"
    entities: str = "cast(array() AS array<string>)"
    bulk: str = "false"


def signals(docs: DataFrame, pack: CompiledPack, text: str = "text", context: Context = Context()) -> DataFrame:
    """Documents with hits, amounts, patterns, negatives, categories and the rule score."""
    prepared = attach_hits(prepare(docs, text), {"hits": pack.terms}, "norm", exclusions=pack.exclusions)
    staged = prepared.select(
        "*",
        F.expr(N.extract_amounts(text)).alias("amounts"),
        F.expr(f"filter({string_array(pack.reversals)}, _t -> contains(norm, _t))").alias("x_terms"),
    )
    staged = staged.withColumn(
        "no_new", F.expr(no_new_information("norm", "size(amounts) > 0", "exists(hits, _h -> _h.ktype = 'E')"))
    )
    flags = (
        "filter(array(CASE WHEN size(x_terms) > 0 THEN 'reversed' END, CASE WHEN no_new THEN 'no_new' END,"
        " CASE WHEN size(amounts) > 0 THEN 'amounts' END), _f -> _f IS NOT NULL)"
    )
    staged = attach_rules(
        staged, pack.blocks(), "norm", patterns="patterns", negatives="negatives", amounts="transform(amounts, _m -> lower(_m.raw))",
        reversals="x_terms", entities=context.entities, flag="no_new", types="array_distinct(transform(hits, _h -> _h.ktype))", flags=flags,
    )
    staged = staged.select(
        "*",
        F.expr("aggregate(negatives, 0D, (_a, _n) -> _a + _n.delta)").alias("delta"),
        F.expr("array_min(transform(negatives, _n -> _n.cap))").alias("cap"),
        F.expr(A.assign_categories("hits", "patterns")).alias("categories"),
        *(F.expr(A.count_type("hits", t)).alias(f"n_{t.lower()}") for t in "HMCE"),
    )
    return staged.withColumn("rule_score", F.expr(A.rule_score("hits", "patterns", "size(amounts)", context.target, "delta", "cap")))


def triage(docs: DataFrame, pack: CompiledPack, text: str = "text", keep: tuple[str, ...] = (), context: Context = Context()) -> DataFrame:
    """One row per document: signals, score dimensions, final score and band.

    ``keep`` names further columns to pass on (``norm`` is the matching form
    of the text).
    """
    base = signals(docs, pack, text, context)
    oldish = any_contains("norm", REPOST_MARKERS)
    base = base.withColumn(
        "novelty", F.expr(S.novelty_score(context.known, "size(amounts) > 0", "n_e > 0", "no_new", oldish))
    )
    scored = A.score_dimensions(base, DIMENSIONS, keep=base.columns)
    gate = S.signal_gate_cap("rule_score", "coalesce(cap, 100D)")
    stage = S.stage_adjust(context.stage, "n_e > 0")
    gate = f"least({gate}, CASE WHEN {context.bulk} THEN {RECEIPT_CAP}D ELSE 100D END)"
    scored = scored.withColumn("score", F.expr(A.final_score("total", stage, "delta", gate)))
    scored = scored.withColumn("band", F.expr(S.band("score")))
    summary = summary_sql(
        "categories", "patterns", "amounts", "transform(filter(hits, _h -> _h.ktype = 'E'), _h -> _h.term)",
        "score", "band", "size(x_terms) > 0",
    )
    reason = A.escalation("rule_score", "patterns", "n_e > 0", "n_h > 0", "size(amounts) > 0")
    return scored.select(
        "doc_id", "hits", "amounts", "patterns", "negatives", "categories", "n_h", "n_m", "n_c", "n_e", "rule_score",
        "dimensions", "total", "delta", "cap", "score", "band", F.expr(summary).alias("summary"), F.expr(reason).alias("escalation"), *keep,
    )


def band_summary(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("band").agg(F.count("*").alias("n_docs"), F.round(F.avg("rule_score"), 4).alias("avg_rule_score"))

"""Quality gates on labelled data and validation of rule packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOWS = ("sentence", "paragraph", "context3", "full")


def gates(predicted: DataFrame, labels: DataFrame, expected: str, accepted: str, min_recall: float = 0.9, max_false: float = 0.1) -> DataFrame:
    """Recall and false-positive gate on labelled documents.

    ``expected`` is a SQL predicate over the label columns, ``accepted`` one
    over the prediction columns.
    """
    joined = labels.join(predicted, "doc_id").select(F.expr(expected).alias("want"), F.expr(accepted).alias("got"))
    counted = joined.agg(
        F.expr("count_if(want)").alias("positives"), F.expr("count_if(want AND got)").alias("hits"),
        F.expr("count_if(NOT want)").alias("negatives"), F.expr("count_if(NOT want AND got)").alias("false_hits"),
    )
    recall = "round(hits / nullif(positives, 0), 4)"
    false_rate = "round(false_hits / nullif(negatives, 0), 4)"
    return counted.select(
        "positives", "hits", "negatives", "false_hits",
        F.expr(f"coalesce({recall}, 1D)").alias("recall"), F.expr(f"coalesce({false_rate}, 0D)").alias("false_rate"),
        F.expr(f"coalesce({recall}, 1D) >= {min_recall}").alias("recall_ok"),
        F.expr(f"coalesce({false_rate}, 0D) <= {max_false}").alias("false_ok"),
    )


def explainability_gate(records: DataFrame, bands=("S", "A", "B"), min_summary: int = 40) -> DataFrame:
    """rule, violations: important records must carry hits, a snippet, a summary and a checklist."""
    rules = {
        "has_hits": "n_hits > 0", "has_snippet": "n_snippets > 0",
        "has_summary": f"length(coalesce(summary, '')) >= {min_summary}", "has_tasks": "n_tasks > 0",
    }
    counted = records.filter(F.col("band").isin(*bands)).agg(*(F.expr(f"count_if(NOT ({p}))").alias(n) for n, p in rules.items()))
    pairs = ", ".join(f"'{n}', {n}" for n in rules)
    return counted.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, violations)")


def validate_pack(categories: DataFrame, terms: DataFrame, patterns: DataFrame, negatives: DataFrame) -> DataFrame:
    """problem, item for everything wrong with a rule pack; an empty result is a valid pack.

    categories: category.  terms: term, ktype, category.  patterns: one row
    per pattern, group and term.  negatives: rule_id, delta, cap.
    """
    known = categories.select("category").distinct()

    def report(df: DataFrame, problem: str, item: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.expr(f"cast({item} AS string)").alias("item"))

    def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).count().filter("count > 1")

    used = patterns.select("pattern_id", F.explode(F.split("category", "[|]")).alias("category"))
    named = patterns.filter("group_kind = 'term'")
    checks = [
        report(repeated(categories, ["category"]), "DUPLICATE_CATEGORY", "category"),
        report(terms.filter("category <> 'GLOBAL'").join(known, "category", "left_anti"), "UNKNOWN_CATEGORY", "concat(term, ':', category)"),
        report(terms.filter("trim(coalesce(term, '')) = ''"), "BLANK_TERM", "category"),
        report(repeated(terms, ["term", "ktype", "category"]), "DUPLICATE_TERM", "concat(category, ':', ktype, ':', term)"),
        report(used.filter("category <> 'GLOBAL'").join(known, "category", "left_anti").distinct(), "UNKNOWN_CATEGORY", "concat(pattern_id, ':', category)"),
        report(
            named.groupBy("pattern_id", "group_no").agg(F.expr("count_if(trim(coalesce(term, '')) <> '')").alias("n")).filter("n = 0"),
            "EMPTY_GROUP", "concat(pattern_id, ':', group_no)",
        ),
        report(repeated(named, ["pattern_id", "group_no", "term"]), "DUPLICATE_TERM", "concat(pattern_id, ':', group_no, ':', term)"),
        report(
            patterns.select("pattern_id", F.explode("windows").alias("w")).filter(~F.col("w").isin(*WINDOWS)).distinct(),
            "BAD_WINDOW", "concat(pattern_id, ':', w)",
        ),
        report(patterns.filter("NOT coalesce(base_score BETWEEN 0 AND 100, false)").select("pattern_id").distinct(), "BAD_SCORE", "pattern_id"),
        report(
            patterns.groupBy("pattern_id").agg(F.countDistinct("category", "base_score").alias("n")).filter("n > 1"),
            "CONFLICTING_PATTERN", "pattern_id",
        ),
        report(repeated(negatives, ["rule_id"]), "DUPLICATE_RULE", "rule_id"),
        report(negatives.filter("delta IS NULL"), "BAD_DELTA", "rule_id"),
        report(negatives.filter("cap IS NOT NULL AND NOT cap BETWEEN 0 AND 100"), "BAD_CAP", "rule_id"),
    ]
    return reduce(DataFrame.unionByName, checks)

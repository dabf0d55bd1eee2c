"""Known cases by the names they are known under: short keys against the entities of documents, in both directions.

Which of many short strings contain which others is asked of distinct strings
only, so an entity that every document holds counts once.  Each needle is
looked up by one of its grams, the rarest by an exact count over the other
side; a gram that occurs nowhere rules its needle out.  Everything is equi-joins
and partial sums of built-in functions: no Python, and no pair is formed that
does not share a needle's rarest gram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import cut_lineage

#: Characters of a gram; shorter needles are looked up whole.
GRAM = 3
RELATIONS = ("EQUAL", "CONTAINS", "PART_OF")


def _grams(text: str, size: str) -> str:
    """Distinct grams of a text."""
    return f"array_distinct(transform(sequence(1, length({text}) - {size} + 1), _i -> substring({text}, _i, {size})))"


def short_candidates(hay: DataFrame, needles: DataFrame, on: list[str], gram: int = GRAM) -> DataFrame:
    """(on, hay, needle): each needle with the texts that hold its rarest gram."""
    sized = needles.filter("length(needle) > 0").withColumn("_size", F.least(F.length("needle"), F.lit(gram)))
    keyed = sized.select(*on, "needle", "_size", F.explode(F.expr(_grams("needle", "_size"))).alias("_gram"))
    keyed = cut_lineage(keyed.withColumn("_total", F.expr("size(" + _grams("needle", "_size") + ")")))
    sizes = F.explode(F.expr(f"filter(sequence(1, {gram}), _n -> _n <= length(hay))")).alias("_size")
    held = hay.filter("length(hay) > 0").select(*on, "hay", sizes).select(*on, "hay", F.explode(F.expr(_grams("hay", "_size"))).alias("_gram"))
    # only grams that some needle has
    held = cut_lineage(held.join(keyed.select(*on, "_gram").distinct(), [*on, "_gram"], "left_semi"))
    often = held.groupBy(*on, "_gram").agg(F.count("*").alias("_often"))
    rarest = keyed.join(often, [*on, "_gram"]).groupBy(*on, "needle", "_total").agg(
        F.min(F.struct("_often", "_gram")).alias("_best"), F.count("*").alias("_found")
    ).filter("_found = _total").select(*on, "needle", F.col("_best._gram").alias("_gram"))
    return held.join(rarest, [*on, "_gram"]).select(*on, "hay", "needle")


def short_contains_join(hay: DataFrame, needles: DataFrame, on: list[str], gram: int = GRAM) -> DataFrame:
    """(on, hay, needle) for all texts of ``hay`` that contain a text of ``needles`` with the same values of ``on``.

    hay: on, hay.  needles: on, needle; both distinct, meant for short texts.
    NULL and empty texts contain nothing and are contained nowhere.
    """
    return short_candidates(hay, needles, on, gram).filter("contains(hay, needle)")


def match_case_keys(entities: DataFrame, keys: DataFrame, fold: str = "{}", gram: int = GRAM) -> DataFrame:
    """doc_id, case_id, matched_keys, n_keys, relation for every document with an entity that a case is known under.

    entities: doc_id, type, text.  keys: case_id, type, key.  An entity
    matches a key of its type that it contains, or that contains it.
    ``matched_keys`` are the entities, sorted; ``relation`` is the closest of
    EQUAL, CONTAINS (the entity is the longer) and PART_OF.  ``fold`` is an SQL
    expression over ``{}`` that brings both sides to one script or case.
    NULL and empty texts match nothing, repeated rows count once.
    """
    # stored, as three joins read it and it may come from a pass over whole texts
    e = cut_lineage(entities.select("doc_id", "type", "text", F.expr(fold.format("text")).alias("name")).filter("length(name) > 0").distinct())
    k = keys.select("case_id", "type", F.expr(fold.format("key")).alias("key")).filter("length(key) > 0").distinct()
    names, wanted = e.select("type", "name").distinct(), k.select("type", "key").distinct()
    longer = short_contains_join(names.withColumnRenamed("name", "hay"), wanted.withColumnRenamed("key", "needle"), ["type"], gram)
    within = short_contains_join(wanted.withColumnRenamed("key", "hay"), names.withColumnRenamed("name", "needle"), ["type"], gram)
    pairs = longer.select("type", F.col("hay").alias("name"), F.col("needle").alias("key")).union(
        within.select("type", F.col("needle").alias("name"), F.col("hay").alias("key"))
    ).distinct()
    # the cases of a name first, so that a key of many cases and a name of many documents meet once
    cases = pairs.join(k, ["type", "key"]).groupBy("type", "name", "case_id").agg(
        F.min(F.expr("CASE WHEN name = key THEN 0 WHEN contains(name, key) THEN 1 ELSE 2 END")).alias("near")
    )
    # sets are gathered once, after the rows have moved: pairs of a document and a case have few rows each
    met = e.join(cases, ["type", "name"]).select("doc_id", "case_id", "text", "near").repartition("doc_id", "case_id")
    found = met.groupBy("doc_id", "case_id").agg(
        F.sort_array(F.collect_set("text")).alias("matched_keys"), F.min("near").alias("near")
    )
    relation = F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("near") + 1)
    return found.select("doc_id", "case_id", "matched_keys", F.size("matched_keys").alias("n_keys"), relation.alias("relation"))

"""Matching dictionary terms and known items in texts.

Terms are found in one narrow pass over the documents, whatever the size of
the pack (see ``matcher``); known items by a containment join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.functions.sql import quote, string_array
from siftline.operators.matcher import Surface, attach_hits, term_hits
from siftline.operators.rows import explode_structs
from siftline.session import cut_lineage, small_batches

HIT_TYPE = (
    "array<struct<surface:string,term:string,ktype:string,category:string,stage:string,count:int,snippet:string>>"
)


def map_variants(terms: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Add a row per surface variant of a dictionary term.

    terms: term, ktype, category, stage.  variants: variant, canonical.
    A variant that is itself a dictionary term keeps its own meaning.
    """
    usable = terms.filter(F.length("term") >= 2).withColumn("stage", F.coalesce("stage", F.lit("")))
    base = usable.select(F.lower("term").alias("surface"), "term", "ktype", "category", "stage")
    out = base
    if variants is not None:
        extra = (
            variants.select(F.lower("variant").alias("surface"), F.col("canonical").alias("term"))
            .join(usable, "term")
            .join(base.select("surface").distinct(), "surface", "left_anti")
            .select("surface", "term", "ktype", "category", "stage")
        )
        out = base.unionByName(extra)
    # one row per surface and meaning, whichever spelling of the term comes first
    return out.groupBy("surface", "ktype", "category").agg(
        F.min("term").alias("term"), F.min("stage").alias("stage")
    )


def resolve_small(terms: Iterable, variants: Iterable = ()) -> list:
    """``map_variants`` for the rows of a small pack that is on the driver already."""
    usable = [t for t in terms if len(t.term) >= 2]
    own = {t.term.lower() for t in usable}
    pairs = [(t.term.lower(), t) for t in usable]
    pairs += [(v.variant.lower(), t) for v in variants if v.variant.lower() not in own for t in usable if t.term == v.canonical]
    best: dict[tuple, tuple] = {}
    for surface, t in pairs:
        key = (surface, t.ktype, t.category)
        term, stage = best.get(key, (t.term, t.stage))
        best[key] = (min(term, t.term), min(stage or "", t.stage or ""))
    return [Surface(s, term, k, c, stage) for (s, k, c), (term, stage) in sorted(best.items())]


def pack_literal(rows: Iterable) -> str:
    """Constant array of (surface, term, ktype, category, stage) for use in a plan."""
    items = sorted((r.surface, r.ktype, r.category, r.term, r.stage or "") for r in rows)
    if not items:
        return "cast(array() AS array<struct<surface:string,term:string,ktype:string,category:string,stage:string>>)"
    structs = (
        f"named_struct('surface', {quote(s)}, 'term', {quote(t)}, 'ktype', {quote(k)},"
        f" 'category', {quote(c)}, 'stage', {quote(g)})"
        for s, k, c, t, g in items
    )
    return "array(" + ", ".join(structs) + ")"


def hits_sql(text: str, pack: str, radius: int = 25) -> str:
    """array of hits of a constant pack in a text, with counts and a snippet."""
    return (
        f"transform(filter({pack}, _k -> contains({text}, _k.surface)), _k -> named_struct("
        "'surface', _k.surface, 'term', _k.term, 'ktype', _k.ktype, 'category', _k.category,"
        f" 'stage', _k.stage, 'count', {T.count_occurrences(text, '_k.surface')},"
        f" 'snippet', {T.snippet(text, '_k.surface', radius)}))"
    )


def match_terms(docs: DataFrame, terms: DataFrame, text: str = "text", variants: DataFrame | None = None) -> DataFrame:
    """Every dictionary term in every document: doc_id, surface, term, ktype, category, stage, count, snippet.

    Occurrences of one term are counted without overlaps.  Packs of any size
    take the same path.
    """
    return term_hits(docs, map_variants(terms, variants), text)


def _gram_hashes(text: str, gram: int) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - gram + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for i in range(gram):
        value = value * np.uint64(1099511628211) + codes[i : i + n]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def _all_marks(text: str, gram: int, window: int) -> np.ndarray:
    """Smallest gram hash of every run of ``window`` grams, as int64."""
    hashes = _gram_hashes(text, gram)
    if len(hashes) < window:
        return np.empty(0, dtype=np.int64)
    if window > 1:
        hashes = np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1)
    return np.unique(hashes).view(np.int64)


def _marks(df: DataFrame, key: str, text: str, gram: int, window: int) -> DataFrame:
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = [_all_marks(t or "", gram, window) for t in batch[text]]
            yield pd.DataFrame(
                {
                    key: np.repeat(batch[key].to_numpy(), [len(m) for m in marks]),
                    "mark": np.concatenate(marks) if marks else np.empty(0, dtype=np.int64),
                }
            )

    source = df.select(F.col(key), F.col(text).alias(text)) if key != text else df.select(F.col(key))
    return small_batches(source).mapInPandas(run, schema=f"{key} {key_type}, mark long")


def containment_candidates(
    hay: DataFrame, hay_key: str, hay_text: str, needles: DataFrame, needle_key: str, needle_text: str, gram: int, window: int,
) -> DataFrame:
    """(hay_key, needle_key) that may be contained: each needle with the texts that hold its rarest mark."""
    floor = gram + window - 1
    longest = hay.agg(F.max(F.length(hay_text))).first()[0] or 0
    needles = needles.filter(F.length(needle_text).between(floor, longest))
    needle_marks = cut_lineage(_marks(needles, needle_key, needle_text, gram, window))
    held = _marks(hay, hay_key, hay_text, gram, window).join(needle_marks.select("mark").distinct(), "mark", "left_semi")
    held = cut_lineage(held)
    often = held.groupBy("mark").agg(F.count("*").alias("often"))
    rarest = needle_marks.join(often, "mark", "left").groupBy(needle_key).agg(
        F.min(F.struct("often", "mark")).alias("best"), F.count("often").alias("found"), F.count("*").alias("all")
    ).filter("found = all").select(needle_key, F.col("best.mark").alias("mark"))
    return held.join(rarest, "mark").select(hay_key, needle_key)


def contains_join(
    hay: DataFrame, hay_key: str, hay_text: str,
    needles: DataFrame, needle_key: str, needle_text: str,
    gram: int = 8, window: int = 17,
) -> DataFrame:
    """(hay_key, needle_key) for every needle that is a substring of a hay text.

    Exact for needles of at least ``gram + window - 1`` characters; shorter
    ones are not matched.  Instead of comparing all pairs, both sides are
    reduced to marks (the smallest gram hash of each run of grams): a text
    that contains a needle has all of the needle's marks.  A needle is looked
    up by its rarest mark, by an exact count over the hay, so a footer that
    all texts share makes no candidates unless a needle is nothing else; a
    needle with a mark that occurs nowhere is out.  A substring test on the
    candidates decides.  Spark picks broadcast or shuffle for the joins from
    the real sizes, and splits a mark that very many texts share.
    """
    candidates = containment_candidates(hay, hay_key, hay_text, needles, needle_key, needle_text, gram, window)
    hay_side = hay.select(hay_key, F.col(hay_text).alias("_hay"))
    if needle_key == needle_text:
        checked = candidates.withColumn("_needle", F.col(needle_key))
    else:
        checked = candidates.join(needles.select(needle_key, F.col(needle_text).alias("_needle")), needle_key)
    return (
        checked.join(hay_side, hay_key)
        .filter("contains(_hay, _needle)")
        .select(hay_key, needle_key)
    )


def known_case_match(docs: DataFrame, cases: DataFrame, text: str = "text", case_text: str = "text", min_chars: int = 24) -> DataFrame:
    """Documents that contain a known case or are contained in one.

    docs: doc_id, text.  cases: item_id, text.  Returns doc_id, item_id,
    relation (EQUAL, QUOTES or PART_OF).  Texts of fewer than ``min_chars``
    characters say too little and are left out; for short keys see
    ``cases.match_case_keys``.  Two containment joins, one for each direction.
    """
    d = docs.select("doc_id", F.expr(text).alias("doc_text"))
    c = cases.select("item_id", F.expr(case_text).alias("case_text"))
    gram = min(8, min_chars)
    window = min_chars - gram + 1
    quotes = contains_join(d, "doc_id", "doc_text", c, "item_id", "case_text", gram, window)
    parts = contains_join(c, "item_id", "case_text", d, "doc_id", "doc_text", gram, window)
    both = quotes.selectExpr("doc_id", "item_id", "1 AS q", "0 AS p").unionByName(
        parts.selectExpr("doc_id", "item_id", "0 AS q", "1 AS p")
    )
    # the same pair found both ways means equal texts; at most two rows meet here
    relation = "CASE WHEN max(q) = 1 AND max(p) = 1 THEN 'EQUAL' WHEN max(q) = 1 THEN 'QUOTES' ELSE 'PART_OF' END"
    return both.groupBy("doc_id", "item_id").agg(F.expr(relation).alias("relation"))


def known_flags(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, known (bool), n_cases for every document."""
    per_doc = matches.groupBy("doc_id").agg(F.count("*").alias("n_cases"))
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id",
        F.col("n_cases").isNotNull().alias("known"),
        F.coalesce("n_cases", F.lit(0)).alias("n_cases"),
    )


def slotted_sql(text: str, slots: str, evidence: str, reversal: str, boosts: str) -> str:
    """Hits of typed slots, plus global terms only where a slot has not already hit them.

    All four are arrays of hits.  Boost terms count once and are described by
    the head of the text.
    """
    fresh = "filter({hits}, _e -> NOT exists({slots}, _x -> _x.term = _e.term AND _x.ktype = _e.ktype))"
    boosted = (
        f"transform({boosts}, _k -> named_struct('surface', _k.surface, 'term', _k.term, 'ktype', _k.ktype, 'category', _k.category,"
        f" 'stage', _k.stage, 'count', 1, 'snippet', concat('…', substring({text}, 1, 60), '…')))"
    )
    return f"concat({slots}, {fresh.format(hits=evidence, slots=slots)}, {fresh.format(hits=reversal, slots=slots)}, {boosted})"


SLOT_RADIUS = 20


def match_terms_slotted(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Slotted matching; ``terms`` has a ``role`` of slot, evidence, reversal or boost.

    All roles are matched in one pass over the texts.
    """
    packs: dict[str, list[Surface]] = {}
    for role in ("slot", "evidence", "reversal", "boost"):
        of_role = map_variants(terms.filter(F.col("role") == role)).select(*Surface._fields)
        packs[f"_{role}"] = [Surface(*r) for r in of_role.toLocalIterator()]
    texts = docs.select("doc_id", F.expr(text).alias("_body"))
    found = attach_hits(texts, packs, "_body", SLOT_RADIUS)
    return explode_structs(found, slotted_sql("_body", *packs), ["doc_id"])


def match_reversal_terms(docs: DataFrame, reversal_terms: list[str], text: str = "text") -> DataFrame:
    """Outcome and negation terms found per document, with a flag."""
    found = f"filter({string_array(reversal_terms)}, _t -> contains({text}, _t))"
    return docs.select("doc_id", F.expr(found).alias("x_terms")).withColumn("reversed", F.expr("size(x_terms) > 0"))

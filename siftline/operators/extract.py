"""Entities and summaries built from extraction expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from siftline.functions import numbers as N
from siftline.functions.sql import let, quote, string_array
from siftline.functions.text import fit
from siftline.operators.rows import explode_structs

TRIMMED = "，。；：！？、（）()「」『』\"'"


def _tidy(text: str) -> str:
    edge = quote(r"(?U)^[\s" + TRIMMED + r"]+|[\s" + TRIMMED + r"]+$")
    return f"regexp_replace({text}, {edge}, '')"


def entities_sql(text: str, patterns: Iterable[tuple[str, str]], names: Iterable[tuple[str, str]] = (), facts: bool = True) -> str:
    """array<struct<type,text,count>>, by type and text: regex and dictionary entities and, with ``facts``, dates, amounts and accounts."""
    by_type: dict[str, list[str]] = {}
    for etype, name in names:
        by_type.setdefault(etype, []).append(name)

    def typed(values: str, etype: str) -> str:
        return f"transform({values}, _v -> named_struct('type', {quote(etype)}, 'text', {_tidy('_v')}))"

    parts = [typed(f"regexp_extract_all({text}, {quote(rx)}, 0)", etype) for etype, rx in patterns]
    for etype, words in sorted(by_type.items()):
        hits = (
            f"flatten(transform(filter({string_array(sorted(words))}, _w -> contains({text}, _w)), _w ->"
            f" array_repeat(_w, cast((length({text}) - length(replace({text}, _w, ''))) DIV length(_w) AS int))))"
        )
        parts.append(typed(hits, etype))
    if facts:
        parts.append(typed(N.extract_dates(text), "DATE"))
        parts.append(typed(f"transform({N.extract_amounts(text)}, _m -> _m.raw)", "MONEY"))
        parts.append(typed(N.extract_accounts(text), "BANK_ACCOUNT"))
    found = f"filter(concat({', '.join(parts)}), _e -> _e.text <> '')"
    # equal ones stand together in sorted order, so a count is the distance to the next different one
    starts = "filter(sequence(1, size(_a)), _i -> _i = 1 OR element_at(_a, _i) <> element_at(_a, _i - 1))"
    counted = (
        "transform(_b, (_i, _k) -> named_struct('type', element_at(_a, _i).type, 'text', element_at(_a, _i).text,"
        " 'count', coalesce(try_element_at(_b, _k + 2), size(_a) + 1) - _i))"
    )
    none = "cast(array() AS array<struct<type:string,text:string,count:int>>)"
    return let("_a", f"array_sort({found})", f"CASE WHEN size(_a) = 0 THEN {none} ELSE {let('_b', starts, counted)} END")


def extract_entities(
    docs: DataFrame, patterns: Iterable[tuple[str, str]], names: Iterable[tuple[str, str]] = (), text: str = "text", facts: bool = True,
) -> DataFrame:
    """doc_id, type, text, count; unique per document, type and text."""
    return explode_structs(docs, entities_sql(text, patterns, names, facts), ["doc_id"])


def summary_sql(categories: str, patterns: str, amounts: str, evidence: str, score: str, band: str, reversed_flag: str, limit: int = 220) -> str:
    """Short summary from the signals of a document, without blanks and cut to length."""
    cats = f"array_join(slice({categories}, 1, 3), '、')"
    pats = f"coalesce(nullif(array_join(slice(transform({patterns}, _p -> _p.pattern_id), 1, 3), '/'), ''), '-')"
    money = (
        f"CASE WHEN size({amounts}) > 0 THEN concat('amounts:', array_join(transform(slice({amounts}, 1, 2), _m ->"
        " concat(_m.raw, '(', format_number(_m.amount, 2), _m.currency, ')')), '、'), '。') ELSE '' END"
    )
    proof = f"coalesce(nullif(array_join(slice({evidence}, 1, 3), '、'), ''), '-')"
    back = f"CASE WHEN {reversed_flag} THEN 'reversed-outcome-on-record。' ELSE '' END"
    return fit(
        f"concat('categories:', {cats}, '。patterns:', {pats}, '。evidence:', {proof}, '。', {money},"
        f" 'score:', format_number({score}, 0), '/', {band}, '。', {back})",
        limit,
    )

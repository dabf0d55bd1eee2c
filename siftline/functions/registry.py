"""The expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from siftline.functions import numbers as N
from siftline.functions import scoring as S
from siftline.functions import text as T

SCALARS = {
    "clean_text": ("t STRING", "STRING", lambda: T.clean_text("t")),
    "normalize_text": ("t STRING", "STRING", lambda: T.normalize_text("t")),
    "extract_amounts": ("t STRING", "ARRAY<STRUCT<amount: DOUBLE, currency: STRING, raw: STRING>>", lambda: N.extract_amounts("t")),
    "parse_number_words": ("t STRING", "DOUBLE", lambda: N.number_words("t")),
    "extract_dates": ("t STRING", "ARRAY<STRING>", lambda: N.extract_dates("t")),
    "band": ("score DOUBLE", "STRING", lambda: S.band("score")),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions.

    They are SQL bodies that Spark inlines into the calling plan, not Python
    functions.  ``split_windows(text, level)`` is a table function for use
    with LATERAL.
    """
    for name, (args, returns, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body()}")
    texts = (
        f"CASE level WHEN 'sentence' THEN {T.sentence_texts('t')} WHEN 'paragraph' THEN {T.paragraph_texts('t')}"
        f" WHEN 'context3' THEN {T.triples(T.sentence_texts('t'))} ELSE array(t) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION split_windows(t STRING, level STRING) RETURNS TABLE(window_no INT, text STRING)"
        f" RETURN SELECT w.window_no, w.text FROM (SELECT posexplode({texts}) AS (window_no, text)) AS w"
    )
    return [*SCALARS, "split_windows"]

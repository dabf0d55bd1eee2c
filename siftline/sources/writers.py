"""Writing results: JSON lines, guarded CSV, folders per band, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.privacy import FORBIDDEN_NAMES
from siftline.functions.sql import quote

FORMULA_START = r"^\s*[=+\-@]"
LARGE_FIELDS = ("text", "body", "norm", "html", "content")


def json_lines(records: DataFrame, min_score: float = 0.0, drop: tuple[str, ...] = LARGE_FIELDS) -> DataFrame:
    """doc_id and one JSON line per record at or above a score, large text fields left out."""
    kept = sorted(c for c in records.columns if c not in drop)
    line = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})
    return records.filter(F.col("score") >= min_score).select("doc_id", line.alias("line"))


def write_jsonl(records: DataFrame, path: str, min_score: float = 0.0) -> None:
    json_lines(records, min_score).select("line").write.mode("overwrite").text(path)


def spreadsheet_safe(column: str) -> str:
    """Text that a spreadsheet would take for a formula gets a leading quote."""
    return f"CASE WHEN {column} RLIKE {quote(FORMULA_START)} THEN concat(\"'\", {column}) ELSE {column} END"


def csv_rows(records: DataFrame, columns: list[str], joiner: str = "、", min_score: float = 0.0) -> DataFrame:
    """Fixed columns, lists joined, text guarded."""
    kinds = dict(records.dtypes)
    out = []
    for c in columns:
        if kinds[c].startswith("array"):
            out.append(F.expr(spreadsheet_safe(f"array_join({c}, {quote(joiner)})")).alias(c))
        elif kinds[c] == "string":
            out.append(F.expr(spreadsheet_safe(c)).alias(c))
        else:
            out.append(F.col(c))
    return records.filter(F.col("score") >= min_score).select(*out)


def write_csv_safe(records: DataFrame, path: str, columns: list[str], min_score: float = 0.0) -> None:
    rows = csv_rows(records, columns, min_score=min_score)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_by_band(records: DataFrame, path: str, bands: tuple[str, ...] = ("S", "A", "B"), rows_per_file: int = 1_000_000) -> None:
    """Accepted records in one folder per band; only the bands written are replaced.

    The rebalance makes files of a sensible size and splits a band that holds
    most of the rows over many tasks.
    """
    (
        records.filter(F.col("band").isin(*bands)).hint("rebalance", "band").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
        .partitionBy("band").parquet(path)
    )


def public_projection(records: DataFrame, allowed: list[str]) -> DataFrame:
    """Only allow-listed columns, and never one with a forbidden name."""
    plain = {c: "".join(ch for ch in c.lower() if ch.isalnum()) for c in records.columns}
    return records.select(*(c for c in allowed if c in plain and plain[c] not in FORBIDDEN_NAMES))

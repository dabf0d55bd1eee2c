"""Delimited text whose records may span lines, split over tasks.

Whether a line begins inside a quoted cell depends on all lines before it.  But
a line is a function of that one bit: it keeps the bit, flips it, or sets it,
whatever it was.  Such functions compose, so every partition of lines is
reduced to one of four kinds, the kinds of earlier partitions are composed (one
row for each partition and file), and windows within a partition give the bit
of every line.  A record begins where the bit is off; only records that span
lines are brought together, all others are read where they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.functions.sql import quote
from siftline.operators.rows import join_null_safe
from siftline.session import cut_lineage

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = rf'(?:{_QUOTED}[^,]*+|[^",][^,]*+|)'
#: A line that begins outside (inside) a quoted cell and ends outside one.
CLOSED_FROM_OUTSIDE = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
CLOSED_FROM_INSIDE = rf'\A[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{_FIELD})*+\z'
#: A cell with what ends it; a last cell whose quotes stay open reaches to the end.
_CELL = rf'({_QUOTED}[^,]*+|"[^"]*+(?:""[^"]*+)*+|[^",][^,]*+|)(?:,|\z)'


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """key (the file), first, second (the order of its lines) and line of text files, which are read in splits."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("key"), F.col("_metadata.file_block_start").alias("first"), F.monotonically_increasing_id().alias("second"), F.col("value").alias("line")
    )
    return lines.withColumn("line", F.when(F.col("first") == 0, F.regexp_replace("line", "^\\uFEFF", "")).otherwise(F.col("line")))


def content_lines(files: DataFrame, key: str = "path") -> DataFrame:
    """The same from contents in a column; bytes that are not UTF-8 are replaced."""
    body = F.regexp_replace(F.decode("content", "UTF-8"), "^\\uFEFF", "")
    lines = files.select(F.col(key).alias("key"), F.posexplode(F.split(body, "\\r\\n|\\r|\\n", -1)).alias("second", "line"), F.size(F.split(body, "\\r\\n|\\r|\\n", -1)).alias("n"))
    # a break at the very end begins no line
    return lines.filter("second + 1 < n OR line <> ''").select("key", F.lit(0).cast("long").alias("first"), F.col("second").cast("long").alias("second"), "line")


def records(lines: DataFrame) -> DataFrame:
    """key, row_no, record: the records of each file in order, numbered from 1; line breaks within a cell become ``\\n``."""
    turn = (
        f"CASE WHEN NOT contains(line, '\"') THEN 'keep' ELSE"
        f" CASE WHEN line RLIKE {quote(CLOSED_FROM_OUTSIDE)} THEN CASE WHEN line RLIKE {quote(CLOSED_FROM_INSIDE)} THEN 'off' ELSE 'keep' END"
        f" ELSE CASE WHEN line RLIKE {quote(CLOSED_FROM_INSIDE)} THEN 'flip' ELSE 'on' END END END"
    )
    order = ["key", "first", "second"]
    ranged = lines.withColumn("_turn", F.expr(turn)).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    # the partition number must not change when a lost task runs again
    ranged = cut_lineage(ranged)

    def state(frame: DataFrame, within: Window) -> DataFrame:
        """``_set`` and ``_flips``: what the lines before a line set the bit to (null: nothing), and whether they flip it afterwards."""
        flips = F.coalesce(F.sum(F.when(F.col("_turn") == "flip", 1).otherwise(0)).over(within), F.lit(0))
        frame = frame.withColumn("_n", flips)
        setting = F.when(F.col("_turn").isin("on", "off"), F.struct((F.col("_turn") == "on").cast("int").alias("value"), F.col("_n").alias("n")))
        last = F.last(setting, ignorenulls=True).over(within)
        return frame.withColumn("_last", last).withColumns({"_set": F.col("_last.value"), "_flips": (F.col("_n") - F.coalesce("_last.n", F.lit(0))) % 2}).drop("_last", "_n")

    inner = Window.partitionBy("_part", "key").orderBy("first", "second").rowsBetween(Window.unboundedPreceding, -1)
    marked = state(ranged, inner)
    # what a whole partition does: the state before its last line, and that line
    last = F.max_by(F.struct("_set", "_flips", "_turn"), F.struct("first", "second")).alias("_l")
    whole = marked.groupBy("key", "_part").agg(last).select(
        "key", "_part",
        F.expr(
            "CASE WHEN _l._turn IN ('on', 'off') THEN _l._turn WHEN _l._set IS NOT NULL THEN"
            " CASE WHEN (_l._set + _l._flips + CASE WHEN _l._turn = 'flip' THEN 1 ELSE 0 END) % 2 = 1 THEN 'on' ELSE 'off' END"
            " WHEN (_l._flips + CASE WHEN _l._turn = 'flip' THEN 1 ELSE 0 END) % 2 = 1 THEN 'flip' ELSE 'keep' END"
        ).alias("_turn"),
    )
    # at most one row for each partition and file
    by_part = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = state(whole, by_part).select("key", "_part", ((F.coalesce("_set", F.lit(0)) + F.col("_flips")) % 2).alias("_carried")).filter("_carried = 1")
    inside = join_null_safe(marked, F.broadcast(carried), ["key", "_part"], "left").withColumn(
        "_inside", (F.coalesce("_set", "_carried", F.lit(0)) + F.col("_flips")) % 2 == 1
    )
    ends_inside = F.expr("CASE _turn WHEN 'keep' THEN _inside WHEN 'flip' THEN NOT _inside ELSE _turn = 'on' END")
    inside = cut_lineage(inside.select(*order, "line", "_part", "_inside", ends_inside.alias("_open")))
    starts = inside.groupBy("key", "_part").agg(F.sum((~F.col("_inside")).cast("long")).alias("_n"))
    earlier = starts.select("key", "_part", F.sum("_n").over(by_part).alias("_before")).filter("_before > 0")
    upto = Window.partitionBy("_part", "key").orderBy("first", "second").rowsBetween(Window.unboundedPreceding, 0)
    numbered = join_null_safe(inside, F.broadcast(earlier), ["key", "_part"], "left").withColumn(
        "row_no", F.sum((~F.col("_inside")).cast("long")).over(upto) + F.coalesce("_before", F.lit(0).cast("long"))
    )
    single = numbered.filter("NOT _inside AND NOT _open").select("key", "row_no", F.col("line").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("first", "second", "line")))
    spread = numbered.filter("_inside OR _open").groupBy("key", "row_no").agg(parts.alias("_p")).select(
        "key", "row_no", F.expr("array_join(transform(_p, _x -> _x.line), '\\n')").alias("record")
    )
    return single.unionByName(spread)


def cells_sql(record: str) -> str:
    """array<struct<col,value>> of the cells of a record that are not blank, trimmed."""
    head = quote(r'\A"([^"]*+(?:""[^"]*+)*+)"?')
    tail = quote(r'\A"[^"]*+(?:""[^"]*+)*+"([^,]*)\z')
    value = f"CASE WHEN startswith(_c, '\"') THEN concat(replace(regexp_extract(_c, {head}, 1), '\"\"', '\"'), regexp_extract(_c, {tail}, 1)) ELSE _c END"
    cells = f"transform(regexp_extract_all({record}, {quote(_CELL)}, 1), (_c, _i) -> named_struct('col', _i + 1, 'value', {T.strip(value)}))"
    return f"filter({cells}, _x -> _x.value <> '')"


def delimited_cells(lines: DataFrame, max_rows: int | None = None) -> DataFrame:
    """key, row_no, text and cells (col, value) of every record with a cell that is not blank.

    ``lines``: see ``text_lines`` and ``content_lines``.  ``max_rows`` returns only
    the head of each file; by default all is returned.
    """
    found = records(lines)
    if max_rows is not None:
        found = found.filter(F.col("row_no") <= max_rows)
    cells = found.select("key", F.col("row_no").cast("int").alias("row_no"), F.expr(cells_sql("record")).alias("cells")).filter("size(cells) > 0")
    return cells.select("key", "row_no", F.expr("array_join(transform(cells, _x -> _x.value), ' | ')").alias("text"), "cells")

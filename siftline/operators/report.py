"""Reporting: lists, details, filters, paging and statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import scoring as S
from siftline.functions.sql import quote, string_array
from siftline.operators.ordered import running

OPEN_STATUSES = ("UNREVIEWED", "VERIFY", "PRIORITY")
IMPORTANT_BANDS = ("S", "A", "B")
TRACKS = ("FIRST", "SECOND", "MIXED", "NONE")
DIRECT_PAGE_ROWS = 10_000


def select_important(scores: DataFrame, bands=IMPORTANT_BANDS, min_score: float = 60.0) -> DataFrame:
    """In a wanted band, or at least the minimum score."""
    return scores.filter(F.expr(f"coalesce(band IN ({', '.join(map(quote, bands))}), false) OR coalesce(score, 0D) >= {quote(min_score)}"))


def min_band_filter(scores: DataFrame, band: str) -> DataFrame:
    """Rows at or above the floor of a band, best first."""
    return scores.filter(F.col("score") >= S.BAND_FLOORS[band.upper()]).orderBy(F.desc("score"), "doc_id")


@dataclass(frozen=True)
class ListFilter:
    """Any of these may be left out; those given must all hold."""

    bands: tuple[str, ...] = ()
    track: str = ""
    status: str = ""
    from_utc: str = ""
    to_utc: str = ""
    category: str = ""
    text: str = ""
    open_only: bool = False

    def condition(self) -> str:
        parts = []
        if self.open_only and not self.status:
            parts.append(f"coalesce(review_status, 'UNREVIEWED') IN ({', '.join(map(quote, OPEN_STATUSES))})")
        if self.bands:
            parts.append(f"band IN ({', '.join(map(quote, self.bands))})")
        if self.track:
            parts.append(f"coalesce(track, 'NONE') = {quote(self.track)}")
        if self.status:
            parts.append(f"coalesce(review_status, 'UNREVIEWED') = {quote(self.status)}")
        if self.from_utc:
            parts.append(f"processed_at >= timestamp {quote(self.from_utc)}")
        if self.to_utc:
            parts.append(f"processed_at < timestamp {quote(self.to_utc)}")
        if self.category:
            wanted = quote(self.category.strip().upper())
            parts.append(f"(exists(categories, _c -> contains(upper(_c), {wanted})) OR contains(coalesce(track, ''), {wanted}))")
        if self.text:
            parts.append(f"(contains(lower(subject), lower({quote(self.text)})) OR contains(lower(coalesce(summary, '')), lower({quote(self.text)})))")
        return " AND ".join(parts) or "true"


def list_filter(listing: DataFrame, wanted: ListFilter) -> DataFrame:
    return listing.filter(wanted.condition())


def document_list(docs: DataFrame, scores: DataFrame, queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every document with its score, queue entry and review, all keyed by doc_id."""
    return (
        docs.join(scores, "doc_id", "left")
        .join(queue.select("doc_id", "summary", F.lit(True).alias("_queued")), "doc_id", "left")
        .join(reviews.select("doc_id", F.col("status").alias("review_status"), "note"), "doc_id", "left")
        .withColumn("in_queue", F.coalesce("_queued", F.lit(False)))
        .drop("_queued")
    )


def priority_order(review_first: bool = False) -> list:
    order = [F.expr(S.band_rank("band")).desc(), F.desc_nulls_last("score"), F.desc_nulls_last("processed_at"), F.asc("doc_id")]
    if review_first:
        order.insert(0, F.expr("CASE WHEN coalesce(review_status, 'UNREVIEWED') = 'PRIORITY' THEN 0 ELSE 1 END"))
    return order


def paginate(listing: DataFrame, page: int, page_size: int, review_first: bool = False) -> DataFrame:
    """One page in priority order; the page number is clamped to those that exist.

    Near pages are a bounded top-n.  Deep pages number the rows by range, so
    that no task has to hold all rows before the page.
    """
    total = listing.count()
    pages = max(1, -(-total // page_size))
    offset = (min(max(1, page), pages) - 1) * page_size
    if offset + page_size <= DIRECT_PAGE_ROWS:
        return listing.orderBy(*priority_order(review_first)).offset(offset).limit(page_size)
    numbered = running(listing, priority_order(review_first), number="_n")
    return numbered.filter(F.col("_n").between(offset + 1, offset + page_size)).orderBy("_n").drop("_n")


def top_k_per_group(table: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """Best k rows of each group.

    Spark keeps the k best of each group before shuffling, so a large group is
    cut down where its rows lie.
    """
    from pyspark.sql import Window

    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def document_detail(docs: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Everything known about the given documents, one row per fact.

    children: section name -> table keyed by doc_id.  Returns doc_id, section
    and the row as JSON.  Facts stay rows, so a document with very many of
    them needs no single task; ``docs`` is usually a few chosen ids, which
    Spark broadcasts.
    """
    ids = docs.select("doc_id").distinct()
    parts = []
    for section, table in children.items():
        rest = sorted(c for c in table.columns if c != "doc_id")
        payload = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
        parts.append(table.join(ids, "doc_id", "left_semi").select("doc_id", F.lit(section).alias("section"), payload.alias("payload")))
    return reduce(DataFrame.unionByName, parts)


def pending_review(scores: DataFrame, reviews: DataFrame, bands=IMPORTANT_BANDS) -> DataFrame:
    """Important documents without a finished review."""
    joined = scores.filter(F.col("band").isin(*bands)).join(
        reviews.select("doc_id", F.col("status").alias("review_status")), "doc_id", "left"
    )
    return joined.withColumn("review_status", F.coalesce("review_status", F.lit("UNREVIEWED"))).filter(
        F.col("review_status").isin(*OPEN_STATUSES)
    )


def utc_day_start(day: str, zone: str) -> str:
    """UTC instant at which a local day starts."""
    return f"to_utc_timestamp(cast({day} AS timestamp), {quote(zone)})"


def dashboard_stats(listing: DataFrame, today: str, zone: str = "UTC", days: int = 7) -> DataFrame:
    """One row of counts for today and the last days in local time, in one pass."""
    day = f"date {quote(today)}"
    start, end = utc_day_start(day, zone), utc_day_start(f"date_add({day}, 1)", zone)
    first = utc_day_start(f"date_sub({day}, {days - 1})", zone)
    is_today = f"processed_at >= {start} AND processed_at < {end}"
    is_recent = f"processed_at >= {first} AND processed_at < {end}"
    open_now = f"coalesce(review_status, 'UNREVIEWED') IN ({', '.join(map(quote, OPEN_STATUSES))})"
    return listing.agg(
        F.expr(f"count_if({is_today})").alias("today_total"),
        F.expr(f"count_if({is_today} AND band IN ('S', 'A'))").alias("today_top"),
        F.expr(f"count_if({is_today} AND (score_b > 0 OR track IN ('SECOND', 'MIXED')))").alias("today_second_track"),
        F.expr(f"count_if(band IN ('S', 'A', 'B') AND {open_now})").alias("pending"),
        F.expr(f"count_if({is_recent})").alias("recent_total"),
        F.expr(f"count_if({is_recent} AND band IN ('S', 'A', 'B'))").alias("recent_important"),
    )


def track_counts(listing: DataFrame, tracks=TRACKS) -> DataFrame:
    """Documents per track, with tracks that have none as 0."""
    counted = listing.groupBy(F.coalesce("track", F.lit("NONE")).alias("track")).agg(F.count("*").alias("n"))
    zeros = listing.sparkSession.range(1).select(F.explode(F.expr(string_array(tracks))).alias("track"), F.lit(0).cast("long").alias("n"))
    return counted.unionByName(zeros).groupBy("track").agg(F.sum("n").alias("n"))


def rollup_summary(listing: DataFrame) -> DataFrame:
    """Counts by band, by track and by both, from one scan."""
    return (
        listing.withColumn("track", F.coalesce("track", F.lit("NONE")))
        .groupingSets([["band"], ["track"], ["band", "track"]], "band", "track")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
        .select(
            F.expr("CASE gid WHEN 1 THEN 'BAND' WHEN 2 THEN 'TRACK' ELSE 'BAND_TRACK' END").alias("level"), "band", "track", "n"
        )
    )


def export_reviewed(reviews: DataFrame, docs: DataFrame, scores: DataFrame, statuses: list[str]) -> DataFrame:
    """Reviewed documents with the chosen statuses, best first, for writing out."""
    chosen = reviews.filter(F.col("status").isin(*statuses)).select("doc_id", F.col("status").alias("review_status"), "note")
    out = chosen.join(docs, "doc_id").join(scores, "doc_id", "left")
    return out.select(
        "doc_id", "subject", F.coalesce("band", F.lit("D")).alias("band"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("track", F.lit("NONE")).alias("track"), "review_status", "note", "text",
    ).orderBy(F.expr(S.band_rank("band")).desc(), F.desc("score"), "doc_id")

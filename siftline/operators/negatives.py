"""Negative rules: conjunctions of present and absent markers that lower a score."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.sql import any_contains, let, quote, string_array, which_contain
from siftline.operators.rows import rule_rows
from siftline.operators.rulepass import attach_rules, negative_rules, rule_blocks

# Markers of bulk mail and of old news.
BULK_TERMS = [
    "退订", "退訂", "unsubscribe", "订阅", "訂閱", "subscribe", "分享给朋友", "轉寄給朋友", "转发给朋友",
    "转发邮件", "email to a friend", "share this", "newsletter", "电子报", "電子報", "广告", "廣告", "促销",
    "促銷", "early bird", "早鸟", "早鳥", "discount", "折扣", "优惠", "優惠", "invitation", "邀请", "邀請",
    "注册", "註冊", "register", "click here", "点此", "點此", "view in browser", "在浏览器中查看",
    "submit your website", "promote your", "rss feeds", "latest posts", "you're following",
    "configure your", "instantly", "receive this email", "不再收到", "停止接收", "manage preferences",
    "阅读全文", "read more", "view this email", "这是广告邮件",
]
OLD_MARKERS = [
    "去年", "先前", "当年", "当时", "旧闻", "过去", "转发", "转贴", "转载", "曾报道", "曾報導", "旧案",
    "当年新闻", "旧新闻",
]
NEWS_MARKERS = ["报道", "報導", "新闻", "新聞", "记者", "記者", "媒体", "媒體"]
RECEIPT_CAP = 15.0


def match_negative_rules(
    docs: DataFrame, rule_negatives: DataFrame, text: str = "text",
    types: str = "cast(array() AS array<string>)", flags: str = "cast(array() AS array<string>)",
) -> DataFrame:
    """doc_id, rule_id, delta, cap, matched_terms of the rules that hold.

    ``types`` is an array of the hit types present, ``flags`` an array of
    document flags.  A rule with delta 0 and no cap is only put on record.
    """
    rules = rule_blocks("negatives", negative_rules(rule_negatives.orderBy("rule_id").toLocalIterator()))
    found = attach_rules(docs, rules, text, negatives="_found", types=types, flags=flags, keep=["doc_id"])
    return found.select("doc_id", F.explode("_found").alias("_item")).select("doc_id", "_item.*")


def sum_negatives(hits: DataFrame) -> DataFrame:
    """Total delta and lowest cap per document (NULL cap when no rule sets one)."""
    return hits.groupBy("doc_id").agg(F.sum("delta").alias("delta"), F.min("cap").alias("cap"))


def promo_flag(text: str, terms: Iterable[str] = BULK_TERMS, has_signal: str = "false") -> str:
    """Bulk mail: three markers, or two and nothing of interest."""
    n = f"size({which_contain(text, terms)})"
    return f"({n} >= 3 OR ({n} >= 2 AND NOT {has_signal}))"


def promo_filter(docs: DataFrame, text: str = "text", terms: Iterable[str] = BULK_TERMS, has_signal: str = "false") -> DataFrame:
    return docs.select(
        "doc_id",
        F.expr(which_contain(text, terms)).alias("markers"),
        F.expr(promo_flag(text, terms, has_signal)).alias("is_promo"),
    )


def bulk_mail_filter(
    docs: DataFrame, domains: DataFrame, signals: Iterable[str], wide: Iterable[str],
    text: str = "text", sender: str = "sender", score: str = "score",
) -> DataFrame:
    """Cap receipts and notices: a listed sender domain and one signal, or two signals and a wide marker.

    domains: domain (one row each, matched as a suffix of the sender's domain).
    """
    signals = list(signals)
    host = f"lower(regexp_extract({sender}, {quote('@([A-Za-z0-9.-]+)')}, 1))"
    # every parent of the sender's domain, so that a suffix test becomes a test for equality
    parents = let("_l", f"split({host}, '[.]')", "transform(sequence(1, size(_l)), _i -> array_join(slice(_l, _i, size(_l)), '.'))")
    listed = string_array(sorted({r.domain.lower() for r in rule_rows(domains)}))
    flagged = docs.withColumn("_listed", F.expr(f"arrays_overlap({parents}, {listed})"))
    hits = which_contain(text, signals)
    bulk = f"((coalesce(_listed, false) AND size({hits}) > 0) OR (size({hits}) >= 2 AND {any_contains(text, wide)}))"
    return flagged.select(
        "doc_id",
        F.expr(bulk).alias("is_bulk"),
        F.expr(hits).alias("signals"),
        F.expr(f"CASE WHEN {bulk} THEN least({score}, {RECEIPT_CAP}D) ELSE {score} END").alias("score"),
    )


def no_new_information(
    text: str, has_amount: str, has_evidence: str,
    old: Iterable[str] = OLD_MARKERS, news: Iterable[str] = NEWS_MARKERS,
) -> str:
    """A repeat of old news: old and news markers, no amount, no evidence."""
    return f"({any_contains(text, old)} AND {any_contains(text, news)} AND NOT {has_amount} AND NOT {has_evidence})"

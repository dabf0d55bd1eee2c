"""The complaint track: measures, marks and categories taken from a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import numbers as N
from siftline.functions.sql import let, quote, string_array, wide_class
from siftline.operators import score as A

# Words that mark a complaint, by what they stand for.
MARKS = {
    "severe": ["停电", "停水", "爆管", "满床", "走廊待床", "不给三联单", "拒绝受理", "吃案", "淹水", "追缴", "追回", "诈骗款"],
    "long_lasting": ["3年", "半年", "一年", "多年", "连续", "反复", "一月", "5次", "6次", "7次", "8天", "两年", "申请截止"],
    "again": ["不是第一次", "已经很多次"],
    "many": [
        "3000户", "500户", "几百人", "几百号", "200号", "100号", "上百户", "几千户", "多名患者", "整个社区", "整区", "同一区", "家长", "上百人",
    ],
    "very_many": ["3000户", "500户", "几百人", "多名患者", "上百户", "上百人", "几千户"],
    "several": ["多名", "共同"],
    "damage": ["设备损坏", "设备坏掉", "电器烧坏", "无法上班", "无法营业", "辞职", "请假"],
    "fraud_loss": ["钱都被转走", "诈骗款"],
    "proof": ["截图", "公文", "错误码", "通知", "时间线", "三联单", "候补", "附件"],
    "dated_proof": ["截图", "公文", "错误码", "通知", "时间线", "三联单"],
    "approved": ["核准"],
    "reclaim": ["追缴", "追回"],
    "give_back": ["追缴", "追回", "返还"],
    "forced_back": ["追缴", "追回", "要求返还", "被迫缴回"],
    "error": ["认定错误", "审核错误"],
    "wrong_decision": ["认定错误", "审核错误", "核准"],
    "reported": ["1999", "市长信箱", "陈情", "投诉", "找议员", "6次", "7次", "多次"],
    "unresolved": ["未改善", "没改善", "未回复", "没消息", "没进度", "仍未"],
    "public": ["停水", "停电", "淹水", "急诊", "病床", "诈骗", "行人", "公托", "社宅"],
    "safety": ["停水", "停电", "淹水", "急诊", "病床", "行人", "路口", "诈骗"],
    "care": ["走廊待床", "医院满床", "等床8天", "急诊塞爆", "挂不到号", "排队黄牛", "等不到病床"],
    "refused": ["吃案", "拒绝受理", "不给三联单", "不立案"],
    "fraud": ["诈骗", "钱都被转走", "诈骗款"],
    "policy_gap": ["政策看得到吃不到", "宣传一套实际一套", "中央说可以地方说不行", "每个县市标准不同", "同样资料不同结果"],
    "disaster": ["淹水", "豪雨", "台风"],
    "late_warning": ["预警太晚", "没人通知", "撤离太晚", "跨局处失灵"],
    "places": ["公托", "公幼", "幼儿园", "托育", "名额不足", "候补", "社宅", "社会住宅"],
    "housing": ["社宅", "社会住宅", "一屋难求", "候补几百", "候补100号", "候补200号"],
    "deadline": ["截止", "截止前"],
}
LASTING_REGEX = r"(?=[\d持长连多半几])(?:(?<!\d)\d++\s*+(?:天|周|月|年|小时|分鐘|分钟|次|户|人|号)|持续|长期|连续|多年|半年|几个月)"
MONEY_REGEX = r"(?=\d)(?:(?<!\d)\d[\d,\.]*+\s*+(?:元|万元|萬)|48000|4\.8[万萬])"
MONEY_WORDS = ["追回", "损失"]
MILD_CASE = (["检伤", "重症优先", "病情较轻"], ["急诊"], ["4小时", "第5级", "五级"])
STRONG_PATTERN = 82.0
PUBLIC_CATEGORIES = ["G06", "G08", "G10", "G11"]
# What a matched pattern stands for; packs with other ids pass their own table.
PATTERN_MARKS = {
    "GP01": ["lasting"], "GP02": ["resubmission"], "GP03": ["severe", "reclaim"], "GP05": ["severe", "lasting", "outage"],
    "GP06": ["lasting", "ignored"], "GP07": ["severe", "severe_group"],
}


def present_words(text: str, words: list[str]) -> str:
    """array<string>: at each place of ``text`` where one of some plain words begins, the longest that does."""
    by_first: dict[str, list[str]] = {}
    for word in sorted(words, key=lambda w: (-len(w), w)):
        by_first.setdefault(word[0], []).append(word[1:])
    tails = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))
    return f"regexp_extract_all({text}, {quote(f'(?=[{wide_class("".join(by_first))}])(?=({tails}))')}, 1)"


def marks_sql(text: str, categories: str) -> str:
    """array<string> of the marks that a text bears.

    One pass finds the words; a word that begins with shorter ones stands for
    their marks too.
    """
    names = [*MARKS, "lasting", "money", "explained", "public_category"]
    mild = {f"mild {n}": words for n, words in enumerate(MILD_CASE)}
    lists = {**MARKS, "money": MONEY_WORDS, **mild}
    numbers = {name: n for n, name in enumerate([*names, *mild], 1)}
    words = sorted({w for listed in lists.values() for w in listed})
    borne = {w: sorted({numbers[m] for m, listed in lists.items() if any(w.startswith(x) for x in listed)}) for w in words}
    table = "map(" + ", ".join(f"{quote(w)}, array({', '.join(map(str, n))})" for w, n in borne.items()) + ")"
    tests = {
        "lasting": f"{text} RLIKE {quote(LASTING_REGEX)}",
        "money": f"{text} RLIKE {quote(MONEY_REGEX)}",
        "explained": " AND ".join(f"array_contains(_n, {numbers[m]})" for m in mild),
        "public_category": f"arrays_overlap({categories}, {string_array(PUBLIC_CATEGORIES)})",
    }
    tested = ", ".join(f"CASE WHEN {p} THEN {numbers[n]} END" for n, p in tests.items())
    found = f"array_sort(array_distinct(filter(concat(_n, array({tested})), _k -> _k <= {len(names)})))"
    found = f"transform({found}, _k -> element_at({string_array(names)}, _k))"
    by_words = f"flatten(transform({present_words(f'coalesce({text}, {quote("")})', words)}, _w -> {table}[_w]))"
    # all but two of the words are written in wide characters
    possible = f"{text} RLIKE {quote(r'[\u4e00-\u9fff]')} OR contains({text}, '1999') OR contains({text}, '48000') OR {tests['public_category']}"
    return f"CASE WHEN {possible} THEN {let('_n', by_words, found)} ELSE cast(array() AS array<string>) END"


def complaint_categories(hits: str, patterns: str) -> str:
    """Pattern categories, then those of strong hits; failing both, the best context category if anything is implied."""
    pattern_cats = f"array_sort(array_distinct(filter(flatten(transform({patterns}, _p -> split(_p.category, '[|]'))), _c -> _c <> '{A.GENERIC_CATEGORY}')))"
    first = f"array_union({pattern_cats}, {A.ranked_categories(hits, ['H'])})"
    implied = f"({A.count_type(hits, 'H')} > 0 OR {A.count_type(hits, 'M')} > 0)"
    context = f"slice({A.ranked_categories(hits, ['C'])}, 1, 1)"
    return let("_f", first, f"CASE WHEN size(_f) > 0 OR NOT {implied} THEN _f ELSE {context} END")


def complaint_measures(docs: DataFrame, text: str, pattern_marks: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` (hits, patterns, delta, cap, has_attachment) with all that ``complaint_score`` needs."""
    table = PATTERN_MARKS if pattern_marks is None else pattern_marks
    pairs = ", ".join(f"{quote(k)}, {string_array(v)}" for k, v in table.items())
    borne = f"array_distinct(flatten(transform(patterns, _p -> coalesce(map({pairs})[_p.pattern_id], cast(array() AS array<string>)))))"
    staged = docs.withColumn("categories", F.expr(complaint_categories("hits", "patterns")))
    staged = staged.select(
        "*",
        *(F.expr(A.count_type("hits", t)).alias(n) for t, n in (
            ("H", "n_h"), ("M", "n_m"), ("E", "n_e"), ("REPEAT", "n_repeat"), ("GROUP_IMPACT", "n_group"), ("LOSS", "n_loss"), ("FAILED", "n_failed"),
        )),
        F.expr(N.extract_population(text)).alias("_population"),
        F.expr(N.extract_duration(text)).alias("_duration"),
        F.expr(N.extract_frequency(text)).alias("_frequency"),
        F.expr(N.extract_loss(text)).alias("money_loss"),
        F.expr(N.extract_waiting(text)).alias("waiting_days"),
        F.expr(N.deadline_pressure(text)).alias("deadline"),
        F.expr(marks_sql(text, "categories")).alias("marks"),
        F.expr(borne).alias("pattern_marks"),
        F.size("patterns").alias("n_patterns"),
        F.expr(f"size(filter(patterns, _p -> _p.score >= {quote(STRONG_PATTERN)}))").alias("n_strong_patterns"),
    )
    return staged.select(
        "*", F.col("_population.value").alias("population"), F.col("_population.confidence").alias("population_confidence"),
        F.col("_duration.days").alias("duration_days"), F.col("_duration.approximate_days").alias("approximate_days"),
        F.col("_frequency.frequency").alias("frequency"), F.col("_frequency.complaint_count").alias("complaint_count"),
    ).drop("_population", "_duration", "_frequency")

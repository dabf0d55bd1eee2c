import datetime
import time

import pytest
from pyspark.sql import functions as F

from siftline.functions import numbers as N
from siftline.functions.sql import any_contains, quote, which_contain, wide_class
from siftline.operators import extract as X
from siftline.plans.triage import prepare


def values(spark, sql, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in df.orderBy("i").select(F.expr(sql)).collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("80万", [(800000.0, "TWD")]), ("80萬元", [(800000.0, "TWD")]), ("800,000", [(800000.0, "TWD")]),
        ("新台币80万元", [(800000.0, "TWD")]), ("人民币20万元", [(200000.0, "TWD")]), ("5000美元", [(5000.0, "USD")]),
        ("NT$800000", [(800000.0, "TWD")]), ("rmb 5000", [(5000.0, "CNY")]), ("八十萬元", [(800000.0, "TWD")]),
        ("一点五亿", [(150000000.0, "TWD")]), ("一亿三千万元", [(130000000.0, "TWD")]), ("一元", []),
        ("US$ 5,000", [(5000.0, "USD")]), ("HK$5,000", [(5000.0, "HKD")]), ("£5,000", [(5000.0, "GBP")]), ("3千万美元", [(30000000.0, "USD")]),
        ("三万亿元", [(3e12, "TWD")]), ("2百万元", [(2000000.0, "TWD")]), ("一万五千亿元", [(1.5e12, "TWD")]), ("三千万美元", [(30000000.0, "USD")]),
        ("1、2、3 与 2026年 30", []), ("$100", []), ("12%", []), ("共 5000元 又 八十元 又 5,000", [(80.0, "TWD"), (5000.0, "TWD")]),
    ],
)
def test_amounts(spark, text, want):
    assert [(m.amount, m.currency) for m in values(spark, N.extract_amounts("text"), [text])[0]] == want


def test_number_words(spark):
    texts = ["一百二十", "十五", "一点五", "三千零六", "两亿三千万", "二十", "x", "", "点五"]
    assert values(spark, N.number_words("text"), texts) == [120, 15, 1.5, 3006, 230000000, 20, None, None, None]
    assert values(spark, N.count_value("text"), ["1,200", "伍佰", "四百", "3千"]) == [1200, 500, 400, None]


def test_dates_and_identifiers(spark):
    text = "2024年 3月 1日, 2024-03-01, 2024/3/1, 3月5日 again 2024/3/1; 1234567890123 a.b@c.org 0912345678"
    assert values(spark, N.extract_dates("text"), [text]) == [["2024年3月1日", "2024-03-01", "2024/3/1", "3月5日"]]
    assert values(spark, N.parse_date("text"), ["2024年3月1日", "3月5日"]) == [datetime.date(2024, 3, 1), None]
    assert values(spark, N.extract_accounts("text"), [text]) == [["1234567890123", "0912345678"]]
    assert values(spark, N.extract_emails("text"), [text]) == [["a.b@c.org"]]
    assert values(spark, N.extract_phones("text"), [text]) == [["0912345678"]]


def test_population(spark):
    got = values(spark, N.extract_population("text"), ["约五百户，超过400户", "数百户", "上千人 和 30户", "无", "百户"])
    assert [tuple(r) for r in got] == [(500, 500, 0.75), (300, 300, 0.8), (1000, 1000, 0.95), (None, None, 0.0), (100, 100, 0.95)]


def test_duration(spark):
    got = values(spark, N.extract_duration("text"), ["8天", "两周", "半年 多年", "2024年", "3年", "12小时", "无"])
    assert [tuple(r) for r in got] == [(8, None), (14, None), (180, 1095), (None, None), (1095, None), (0.5, None), (None, None)]


def test_frequency_loss_waiting(spark):
    got = values(spark, N.extract_frequency("text"), ["五次", "屡次", "陈情 投诉", "7次 反复 1999", "无"])
    assert [tuple(r) for r in got] == [(5, None), (3, None), (2, 2), (7, 1), (None, None)]
    assert values(spark, N.extract_loss("text"), ["损失5万元和80元", "5 元", "无"]) == [50000, 5, None]
    assert values(spark, N.extract_waiting("text"), ["等床8天", "等候两个月", "排队 3周", "无"]) == [8, 60, 21, None]
    assert values(spark, N.deadline_pressure("text"), ["补件期限", "无"]) == [True, False]


def test_entities(spark):
    df = spark.createDataFrame([(1, "Acme Corp and Acme Corp met GNU. 2024-01-02 paid 80万元; 1234567890")], "doc_id int, text string")
    got = X.extract_entities(df, [("COMPANY", r"[A-Z]\w+ Corp")], [("ORG", "GNU")])
    assert {(r.type, r.text, r["count"]) for r in got.collect()} == {
        ("COMPANY", "Acme Corp", 2), ("ORG", "GNU", 1), ("DATE", "2024-01-02", 1), ("MONEY", "80万元", 1), ("BANK_ACCOUNT", "1234567890", 1),
    }


@pytest.mark.parametrize(
    "text, want",
    [
        ("gntdteg.83@mail4.example.com", []), ("halynt$$$ 83 x", []), ("nt$$$ 83", []), ("83 kermb", []), ("körmb 83", []), ("akrmbx 83", []),
        # the letter that makes it no word of its own stands 13 characters before
        ("xntd 12345678 83", []), ("xrmb abcdefg 83", []),
        ("NTD 83", [(83.0, "TWD")]), ("83 NTD", [(83.0, "TWD")]), ("约NT$83", [(83.0, "TWD")]), ("83 rmb", [(83.0, "CNY")]), ("共rmb 83", [(83.0, "CNY")]),
        ("rmb abcdefg 83", [(83.0, "CNY")]), ("rmb abcdefgh 83", []), ("83 abcdefg rmb", [(83.0, "CNY")]), ("83 abcdefgh rmb", []),
    ],
)
def test_currency_marks_are_words_of_their_own(spark, text, want):
    assert [(m.amount, m.currency) for m in values(spark, N.extract_amounts("text"), [text])[0]] == want


def test_counts_without_a_unit_cost_no_more_than_their_length(spark):
    texts = ["共" + "1" * 40_000 + "x 约 5户", "共" + "一" * 40_000 + "x 至少 6户", "数 百户", "3数百户", "约百人", "二百百户", ",34户", "1,2户", "约\x015户"]
    start = time.perf_counter()
    got = values(spark, N.extract_population("text"), texts)
    assert time.perf_counter() - start < 10
    assert [(r.value, r.confidence) for r in got] == [
        (5, 0.75), (6, 0.8), (None, 0.0), (300, 0.8), (100, 0.75), (300, 0.95), (34, 0.95), (12, 0.95), (5, 0.75),
    ]


def test_a_wide_class_holds_its_characters_and_no_others(spark):
    chars = [chr(c) for c in (*range(0x20, 0x7F), *range(0x3000, 0x3010), *range(0x4E00, 0xA000))]
    got = values(spark, f"text RLIKE {quote('^[' + wide_class(N.COUNT_CHARS) + ']$')}", chars)
    assert {c for c, found in zip(chars, got, strict=True) if found} == set(N.COUNT_CHARS)


def test_a_text_is_prepared_once_for_all_words(spark):
    docs = prepare(spark.createDataFrame([(1, "A　stupid\ttext"), (2, None), (3, "none")], "doc_id int, text string"))
    for made, want in ((any_contains, [True, False, False]), (which_contain, [["stupid"], [], []])):
        found = docs.select("doc_id", F.expr(made("norm", ["stupid", "idiot"])).alias("found"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        inner = plan.split("exists(" if made is any_contains else "filter(")[1]
        assert "regexp_replace" in plan and "regexp_replace" not in inner
        assert [r.found for r in found.orderBy("doc_id").collect()] == want

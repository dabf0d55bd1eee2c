"""Complaint track on hand-made texts; the expected points are added up in the comments."""

import re

from pyspark.sql import functions as F

from siftline.operators import complaints as C
from siftline.plans import packs as K
from siftline.plans import records as RC


def score(spark, *texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = RC.complaint_triage(docs, K.demo_complaint_pack(spark).compile(), **kw).collect()
    return {r.doc_id: r for r in rows}


def test_points_add_up(spark):
    got = score(
        spark,
        "社区停电反复，影响约500户，已30天，损失50000元，投诉5次仍未改善",
        "停电 已解决",
        "今天天气很好",
        "申请退件",
        "急诊 检伤 等了4小时 停电 停水",
        "补件之后退件，退件之后补件，停电停水",
    )
    r = got[0]
    # severity: outage pattern; duration: pattern; group: 500 households; loss: money; remedy: five reports; interest: group
    assert (r.severity, r.duration, r.group_impact, r.loss, r.evidence, r.failed_remedy, r.public_interest) == (17, 11, 12, 9, 2, 7, 9)
    # lasting and shared 6, without effect 8, safety 4, failing service 12
    assert (r.bonus, r.complaint_score, r.complaint_band, r.categories) == (30, 97, "S", ["G08"])
    assert (r.population, r.duration_days, r.money_loss, r.frequency, r.complaint_count) == (500, 30, 50000, 5, 1)
    # 16 + 2 + 7 and 4 for safety, less 30 for a closed case
    assert (got[1].complaint_score, got[1].complaint_band) == (0, "D") and [n.rule_id for n in got[1].negatives] == ["GN04"]
    assert got[2].complaint_score == 0 and got[2].categories == []
    # nothing strong, no pattern, little else: 4 + 2 + 3 stays far below the bound of 38
    assert got[3].complaint_score == 9 and got[3].categories == ["G01"]
    assert got[4].complaint_score <= 45  # an explained wait
    assert [p.pattern_id for p in got[5].patterns] == ["GP02"] and got[5].categories == ["G01", "G08"]


def test_attachment_and_systemic_rules(spark):
    got = score(spark, "停电 公文 时间线", has_attachment="true")[0]
    # 16 severity, 12 evidence (attachment and named proof), 7 interest; 4 safety, 4 dated proof
    assert (got.severity, got.evidence, got.public_interest, got.bonus, got.complaint_score) == (16, 12, 7, 8, 43)
    crime = score(spark, "派出所不立案，诈骗", "走廊待床 多名", "走廊待床")
    assert (crime[0].severity, crime[0].duration, crime[0].loss, crime[0].public_interest) == (20, 9, 13, 9)
    assert (crime[1].severity, crime[1].duration, crime[1].group_impact, crime[1].public_interest) == (18, 8, 12, 10)
    assert (crime[2].severity, crime[2].duration, crime[2].group_impact) == (18, 8, 0)


def test_records_keep_both_tracks(spark):
    docs = spark.createDataFrame(
        [(1, "社区停电反复，影响约500户，已30天，损失50000元，投诉5次仍未改善"), (2, "worthless stupid idiot trash the that with " * 3 + "token token"), (3, "plain")],
        "doc_id int, text string",
    )
    out = {r.doc_id: r for r in RC.two_track_records(docs, K.demo_pack(spark).compile(), K.demo_complaint_pack(spark).compile()).collect()}
    assert (out[1].track, out[1].score, out[1].band, out[1].complaint_categories) == ("SECOND", 97.0, "S", ["G08"])
    assert out[1].summary.startswith("complaint(G08)，lasting:30d，affected:500，reports:5，loss:50,000")
    assert out[2].first_score > 40 and out[2].first_categories == ["C01", "C03"] and out[2].evidence_shapes == ["MULTI_SOURCE_PACKAGE"]
    assert (out[3].track, out[3].band, out[3].confidence) == ("NONE", "D", 0.0)
    assert all(r.ref.startswith("REF:") and r.score >= max(r.first_score, r.second_score) for r in out.values())


def test_one_pass_finds_the_words_of_all_marks(spark):
    words = sorted({w for listed in C.MARKS.values() for w in listed})
    texts = [*words, *(a + b for a, b in zip(words, words[1:])), "诈骗" * 3 + "款", "申请截止前", "检伤 急诊 4小时", "检伤 4小时", "追回", "7人", "7 ,人", "14800057", "5,0.元", "plain", "", None]
    sql = C.marks_sql("text", "array('C')")
    assert sql.count("contains(text") <= 2  # the two words in digits; each word was looked for by itself before
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(F.expr(sql)).collect()]
    for text, marks in zip(texts, got, strict=True):
        text = text or ""
        want = [name for name, listed in C.MARKS.items() if any(w in text for w in listed)]
        if re.search("[一-鿿]|1999|48000", text):
            want += ["lasting"] * bool(re.search("[0-9]+[ ]*(天|周|月|年|小时|分鐘|分钟|次|户|人|号)|持续|长期|连续|多年|半年|几个月", text))
            want += ["money"] * bool(re.search("[0-9][0-9,.]*(元|万元|萬)|48000|4[.]8万|4[.]8萬|追回|损失", text))
            want += ["explained"] * all(any(w in text for w in listed) for listed in C.MILD_CASE)
        assert marks == want, text

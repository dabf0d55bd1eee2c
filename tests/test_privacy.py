import re

import pytest
from pyspark.sql import functions as F

from siftline.functions import privacy as P
from siftline.operators import privacy as PV
from siftline.sources import writers as WR

SAMPLES = [
    "mail a.b@example.org or call 0912-345-678, id A123456789, acct 1234567890123",
    "token = abc123, password: hunter2; Bearer abcdefghijkl sk-abcdefgh12345",
    "see /home/user/notes.txt and C:\\Users\\me\\x.doc from 10.0.0.1 by @handle_1",
    "王小明昨天 表示；联系人：李四光 住址：台北市中山路一段5號3樓",
    "John Smith met <id.1@host> line id: some.user1 RAW_PRIVATE_CANARY_7X",
    "nothing to see", "", "李先生 ○○ 张○○",
]
CONTROLS = "pwd=a\x01b c@d.org \x01 1234567890"


def frame(spark, texts=SAMPLES):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def reference_scan(text):
    """The same selection written plainly: by priority, start and length, never overlapping."""
    found = []
    for p in P.SENSITIVE:
        for m in re.finditer(p.regex, text):
            found.append((p.priority, m.start(), -(m.end() - m.start()), m.end(), p.kind))
    kept = []
    for _, start, _, end, kind in sorted(found):
        if all(end <= a or start >= b for a, b, _ in kept):
            kept.append((start, end, kind))
    return sorted(kept)


def test_scan_agrees_with_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("int").alias("doc_id"), "text")
    df = frame(spark).withColumn("doc_id", F.col("doc_id") + 10_000).unionByName(docs)
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {}
    for r in PV.scan_sensitive(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.kind))
    for doc_id, text in texts.items():
        assert sorted(got.get(doc_id, [])) == reference_scan(text), text[:200]
    assert len({k for v in got.values() for *_, k in v}) >= 12


def test_redacted_text_is_clean_and_stable(spark):
    once = PV.redact(frame(spark))
    rows = {r.doc_id: r for r in once.collect()}
    assert rows[5].text == "nothing to see" and rows[5].n_findings == 0 and rows[6].text == ""
    assert "hunter2" not in rows[1].text and "example.org" not in rows[0].text and rows[0].n_findings == 4
    twice = {r.doc_id: r for r in PV.redact(once.select("doc_id", "text")).collect()}
    assert all(twice[i].text == rows[i].text and twice[i].n_findings == 0 for i in rows)


def test_control_characters_do_not_shift_offsets(spark):
    row = PV.redact(frame(spark, [CONTROLS])).first()
    assert row.text.endswith("[REDACTED_EMAIL] \x01 [REDACTED_ACCOUNT]") and row.n_findings == 3


def test_preview_hides_the_value(spark):
    got = PV.scan_sensitive(frame(spark, ["x@y.org 1234567890123"])).collect()
    assert {(r.kind, r.preview) for r in got} == {("EMAIL", "x@***rg"), ("BANK_ACCOUNT", "12*********23")}


def test_masks(spark):
    df = spark.createDataFrame([("acct 1234567890 id A123456789 tel 0912345678 a12345", "alice@x.org"), ("", "bob"), ("x", "")], "text string, sender string")
    got = [tuple(r) for r in df.select(F.expr(P.mask_identifiers("text")), F.expr(P.mask_sender("sender"))).collect()]
    assert got == [("acct 123******* id A**** tel 091******* a12345", "al***@x.org"), ("", "***"), ("x", "?")]


def test_pseudonyms_start_anew_per_document(spark):
    rows = [(1, "company", "Acme", 5), (1, "company", "Acme", 1), (1, "company", "Bolt", 3), (1, "informant", "X", 2), (2, "company", "Bolt", 0), (2, "odd kind", "Z", 1)]
    got = PV.pseudonymize(spark.createDataFrame(rows, "doc_id int, kind string, text string, pos int"))
    assert {(r.doc_id, r.text, r.token) for r in got.collect()} == {
        (1, "Acme", "COMPANY_01"), (1, "Bolt", "COMPANY_02"), (1, "X", "SOURCE_01"), (2, "Bolt", "COMPANY_01"), (2, "Z", "ODD_KIND_01"),
    }


def test_outbound_check(spark):
    df = frame(spark, ["fine", "a@b.org and 10.0.0.1", "y" * 500])
    got = {r.doc_id: (r.allowed, r.reasons) for r in PV.outbound_check(df.withColumnRenamed("text", "summary"), max_bytes=300).collect()}
    assert got == {0: (True, []), 1: (False, ["SENSITIVE_CONTENT:EMAIL", "SENSITIVE_CONTENT:IP"]), 2: (False, ["PAYLOAD_TOO_LARGE"])}
    nested = df.select("doc_id", F.struct(F.lit(1).alias("apiKey"), F.lit(2).alias("n")).alias("meta"))
    assert {tuple(r.reasons) for r in PV.outbound_check(nested).collect()} == {("FORBIDDEN_NAME:apiKey",)}


@pytest.mark.parametrize("leak", ["see C:\\temp\\notes for it", "\\\\srv\\new\\x", "tab\there a@b.org", 'quoted "10.0.0.1"', "line\nC:\\new\\table"])
def test_outbound_check_reads_values_at_any_depth(spark, leak):
    one = spark.createDataFrame([(1, leak)], "doc_id long, v string")
    shapes = ["v", "array(v)", "named_struct('a', named_struct('b', array(v)))", "map('k', v)", "map(v, 'x')", "array(map('k', array(v)))"]
    for shape in shapes:
        got = PV.outbound_check(one.selectExpr("doc_id", f"{shape} AS summary")).first()
        assert not got.allowed and any(r.startswith("SENSITIVE_CONTENT") for r in got.reasons), shape
        assert PV.outbound_check(one.selectExpr("doc_id", shape.replace("v", "'plain words'") + " AS summary") if shape == "v" else one.selectExpr("doc_id", "array('plain') AS summary")).first().allowed


def test_outbound_check_reads_map_keys(spark):
    df = spark.createDataFrame([(1, {"api_key": "1"}), (2, {"ok": "1"}), (3, None)], "doc_id long, m map<string,string>")
    got = {r.doc_id: r.reasons for r in PV.outbound_check(df).collect()}
    assert "FORBIDDEN_NAME:api_key" in got[1] and got[2] == [] and got[3] == []
    deep = df.filter("doc_id = 1").selectExpr("doc_id", "array(named_struct('x', map('body_text', 'y'))) AS z")
    assert PV.outbound_check(deep).first().reasons == ["FORBIDDEN_NAME:body_text"]


def test_projection_and_guarded_cells(spark):
    df = spark.createDataFrame([(1, "=SUM(1)", "  +x", "ok", 90.0)], "doc_id int, a string, sender string, c string, score double")
    assert WR.public_projection(df, ["doc_id", "a", "sender", "missing"]).columns == ["doc_id", "a"]
    assert tuple(WR.csv_rows(df, ["a", "sender", "c"]).first()) == ("'=SUM(1)", "'  +x", "ok")


def test_secret_scan_allows_example_addresses(spark):
    lines = spark.createDataFrame([("f", 1, "x@example.org y@real.net"), ("f", 2, "sk-" + "a" * 24), ("f", 3, "clean")], "path string, line_no int, value string")
    assert {(r.line_no, r.kind) for r in PV.secret_scan(lines).collect()} == {(1, "PRIVATE_EMAIL"), (2, "API_KEY")}


def test_overlaps_are_settled_by_cluster(spark):
    import random
    import time

    rng = random.Random(21)
    rows = []
    for i in range(120):
        rows.append((i, [("K", s, s + rng.randint(1, 6), "R", rng.randint(0, 4)) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 30)))]))
    # one text with 100 000 findings, of which every other one overlaps the one before
    rows.append((999, [("K", 10 * k + (3 if k % 2 else 0), 10 * k + 12, "R", k % 3) for k in range(100_000)]))
    df = spark.createDataFrame(rows, f"doc_id int, found {P.FINDING}")
    begin = time.time()
    got = {r.doc_id: [(f.start, f.end, f.priority) for f in r.kept] for r in df.select("doc_id", F.expr(P.resolve_overlaps("found")).alias("kept")).collect()}
    assert time.time() - begin < 120
    for i, found in rows[:-1]:
        kept = []
        for _, s, e, _, p in sorted(found, key=lambda f: (f[4], f[1], f[1] - f[2])):
            if all(e <= a or s >= b for a, b, _ in kept):
                kept.append((s, e, p))
        assert got[i] == sorted(kept)
    ends = [0]
    for s, e, _ in got[999]:
        assert s >= ends[-1]
        ends.append(e)
    assert len(got[999]) > 30_000

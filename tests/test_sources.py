import csv
import io
import random
import os
from email.mime.application import MIMEApplication
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

from pyspark.sql import functions as F

from siftline.sources.readers import html_to_text
from siftline.functions.registry import register_sql_functions
from siftline.sources import readers as RD
from siftline.sources import writers as WR


def write(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def mail(subject, body, html=False, mid="<Ab.1@Host>", attach=()):
    m = MIMEMultipart()
    m["Subject"], m["From"], m["To"], m["Cc"] = subject, "A B <a@x.org>", "c@x.org, D <d@x.org>", "e@x.org"
    if mid:
        m["Message-ID"] = mid
    m.attach(MIMEText(body, "html" if html else "plain", "utf-8"))
    for name, data in attach:
        part = MIMEApplication(data)
        part.add_header("Content-Disposition", "attachment", filename=name)
        m.attach(part)
    return m.as_bytes()


def test_files_and_mails(spark, tmp_path):
    root = str(tmp_path)
    csv = "\ufeffk,v\n1,\"a, \"\"q\"\"\nnext\"\n,\n2, x \n".encode()
    write(root, "in/1.eml", mail("主题 one", "你好\r\n\r\n\r\n\r\nworld  x", attach=[("t.csv", csv), ("again.csv", csv)]))
    write(root, "in/deep/er/2.eml", mail("html", "<p>a</p><p>b&amp;c</p>", html=True, mid=None))
    write(root, "in/3.txt", b"x")
    write(root, "__MACOSX/4.eml", b"x")
    write(root, "in/._5.eml", b"x")
    files = RD.read_documents(spark, root, max_depth=3)
    assert sorted(r.rel_path for r in files.collect()) == ["in/1.eml", "in/deep/er/2.eml"]
    assert [r.rel_path for r in RD.read_documents(spark, root, max_depth=1).collect()] == ["in/1.eml"]

    mails = RD.parse_mail(files).orderBy("path")
    one, two = mails.collect()
    assert (one.subject, one.sender, one.recipients, one.cc) == ("主题 one", "A B <a@x.org>", ["c@x.org", "D <d@x.org>"], ["e@x.org"])
    assert one.body == "你好\n\nworld x" and one.message_id == "Ab.1@Host" and one.doc_id.startswith("MID:")
    assert two.body == "a\nb&c" and two.doc_id == "RAW:" + two.raw_sha256
    atts = RD.attachments_of(mails)
    assert [(r.filename, r.file_type, r.size) for r in atts.collect()] == [("t.csv", "csv", len(csv))]
    rows = RD.read_delimited_cells(atts.select("sha256", "content"), "sha256").orderBy("row_no").collect()
    assert [(r.row_no, r.text, [(c.col, c.value) for c in r.cells]) for r in rows] == [
        (1, "k | v", [(1, "k"), (2, "v")]), (2, '1 | a, "q"\nnext', [(1, "1"), (2, 'a, "q"\nnext')]), (4, "2 | x", [(1, "2"), (2, "x")]),
    ]
    assert RD.read_delimited_cells(atts.select("sha256", "content"), "sha256", max_rows=1).count() == 1


def test_read_text(spark, tmp_path):
    write(str(tmp_path), "a.txt", "\ufeff你好\r\nx  y \n".encode())
    assert RD.read_text(spark, str(tmp_path)).first().text == "你好\nx y"


def test_band_folders_replace_only_what_is_written(spark, tmp_path):
    out = str(tmp_path / "bands")
    WR.write_by_band(spark.createDataFrame([(1, "S"), (2, "A"), (3, "D")], "doc_id int, band string"), out)
    WR.write_by_band(spark.createDataFrame([(4, "S")], "doc_id int, band string"), out)
    assert {(r.doc_id, r.band) for r in spark.read.parquet(out).collect()} == {(4, "S"), (2, "A")}


def test_json_lines_leave_large_fields_out(spark):
    df = spark.createDataFrame([(1, 80.0, "long", None), (2, 10.0, "long", "b")], "doc_id int, score double, text string, note string")
    assert [tuple(r) for r in WR.json_lines(df, 50.0).collect()] == [(1, '{"doc_id":1,"note":null,"score":80.0}')]


def test_sql_functions(spark):
    assert "split_windows" in register_sql_functions(spark)
    got = spark.sql("SELECT clean_text(' a  b '), normalize_text('A，B'), extract_amounts('80万')[0].amount, parse_number_words('十五'), extract_dates('3月5日'), band(61D)").first()
    assert tuple(got) == ("a b", "a b", 800000.0, 15.0, ["3月5日"], "B")
    spark.createDataFrame([(1, "a。b\n\nc"), (2, "")], "id int, t string").createOrReplaceTempView("_w")
    for level, want in {"sentence": ["a。", "b", "c"], "paragraph": ["a。b", "c"], "context3": ["a。\nb\nc", "b\nc", "c"]}.items():
        rows = spark.sql(f"SELECT w.window_no, w.text FROM _w, LATERAL split_windows(_w.t, '{level}') w ORDER BY 1").collect()
        assert [r.text for r in rows] == want


def test_tasks_need_no_copy_of_the_package():
    from pyspark import cloudpickle

    from siftline.operators import terms

    data = cloudpickle.dumps(lambda t: terms._all_marks(t, 8, 17))
    assert b"siftline.operators" not in data or cloudpickle.loads(data)("x" * 40) is not None


def test_html_attributes_and_references(spark):
    pages = ["<a title='x>y'>z</a>", '<p title="a>b">c</p>', "a &check; b", "a&nbsp&lt b", "&#65;&#x42 &amp;lt; &nosuch; &copy2", "x <3 y"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = [r.text for r in html_to_text(df).orderBy("i").collect()]
    assert got == ["z", "c", "a \u2713 b", "a\u00a0< b", "AB &lt; &nosuch; \u00a92", "x <3 y"]


def plain_cells(body):
    out = []
    for n, row in enumerate(csv.reader(io.StringIO(body.replace("\r\n", "\n").replace("\r", "\n"))), 1):
        cells = [(i, v.strip()) for i, v in enumerate(row, 1) if v.strip()]
        if cells:
            out.append((n, cells))
    return out


def delimited_bodies():
    rng = random.Random(4)
    out = ["", "\n", "a,b\n", '"x\ny",z\r\n"q""r",s\n', 'a,"b\n\nc",d\n\ne', '5" pipe,x\n"a"b"c,d\n', "a,,b\n,,\n x , y ", '"open\nto,the end']
    for _ in range(150):
        out.append("".join(rng.choice(['"', '""', ",", "\n", "a", "b c", "\r\n", " ", '","', '"\n']) for _ in range(rng.randint(1, 60))))
    return out


def test_delimited_cells_equal_the_csv_reader(spark):
    bodies = delimited_bodies()
    files = spark.createDataFrame([(i, bytearray(b.encode())) for i, b in enumerate(bodies)], "file_id int, content binary")
    got = {}
    for r in RD.read_delimited_cells(files, "file_id").collect():
        got.setdefault(r.file_id, []).append((r.row_no, [tuple(c) for c in r.cells]))
    assert {k: sorted(v) for k, v in got.items()} == {i: p for i, b in enumerate(bodies) if (p := plain_cells(b))}
    head = RD.read_delimited_cells(files, "file_id", max_rows=1).collect()
    assert {r.row_no for r in head} == {1}


def test_one_large_file_is_read_in_splits(spark, tmp_path):
    rng = random.Random(6)
    body = "﻿" + "\n".join(
        ",".join('"' + rng.choice(["x\ny", 'q""r', "a,b", "\n\n"]) + '"' if rng.random() < 0.3 else rng.choice(["a", " b ", "", "c d"]) for _ in range(4)) for _ in range(3000)
    )
    (tmp_path / "one.csv").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = sorted((r.row_no, [tuple(c) for c in r.cells]) for r in RD.read_delimited_files(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == plain_cells(body.removeprefix("﻿"))


def test_references_cut_off_before_their_end_stay(spark):
    pages = spark.createDataFrame([("<title>a &amp;&amp;&amp</title><p>x &amp</b>y &lt b &#65<br>&#65; &co<i> &copy",)], "html string")
    assert html_to_text(pages).first().text == "a &&&amp\nx &ampy < b &#65\nA &co &copy"


def test_header_lines(spark):
    from siftline.operators.ingest import valid_header

    heads = {
        "From the board of\nthis": False, "From a@b.c Mon Jan  1 00:00:00 2024\n": True, "From x": True, "Subject: a": True, "x\nTo:\tb": True,
        "Note:\n  prose goes on": False, "a b: c": False, "x\rTo: b": False, "": False,
    }
    df = spark.createDataFrame(list(heads.items()), "head string, want boolean")
    assert {r.head: r.ok for r in df.select("head", F.expr(valid_header("head")).alias("ok")).collect()} == heads


def test_documents_are_written_as_several_delimited_files(spark, monkeypatch):
    from siftline.plans import catalog_store  # noqa: F401
    from siftline.plans.catalog import QUERIES

    read, seen = RD.read_delimited_files, []
    monkeypatch.setattr(RD, "read_delimited_files", lambda s, path: seen.append(s.read.text(path).inputFiles()) or read(s, path))
    assert QUERIES["read_delimited_files"](spark, "/root/testdata/sf0.001").count() == 200
    assert len(seen[0]) > 1


def test_whole_texts_are_normalised_before_they_are_taken_apart(spark):
    from siftline.plans import catalog_store  # noqa: F401
    from siftline.plans.catalog import QUERIES

    plan = QUERIES["sql_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan[: plan.index("Generate")]


def test_many_texts_in_one_file(spark, tmp_path):
    from siftline.functions import text as T
    from siftline.plans import catalog_store as C

    texts = ["", "a", " a\r", "\n\n\n\nb\n\n\n\n", f"{C.MARK}=3\nx", f"{C.MARK}-", f"{C.MARK}{C.MARK}=", "\u3000\ufeffq\t \x01", None, "c\r\n\r\n\r\nd "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    folder = C._as_files(docs, f"{tmp_path}/files")
    assert sum(n.startswith("part-") for n in os.listdir(folder)) == 1
    got = C._texts(RD.read_documents(spark, folder, "txt"), "cast(content AS string)")
    assert {r.doc_id: r.text for r in got.collect()} == {i: (t or "") + "\n" for i, t in enumerate(texts)}
    clean = {r.doc_id: r.t for r in docs.select("doc_id", F.expr(T.clean_text("text")).alias("t")).collect()}
    got = C._texts(RD.read_text(spark, folder), "text").select("doc_id", F.expr(T.strip("text")).alias("text"))
    assert {r.doc_id: r.text for r in got.collect()} == clean


def with_odd_rows(spark, folder, texts):
    """Rows of ``documents`` with the given texts, under ids that are multiples of 31, others, and null."""
    rows = [(i, t, lang) for n, t in enumerate(texts) for i, lang in ((31 * n, "en"), (31 * n + 7, None), (None, 'a"b,\nc'))]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def same_as_sql(spark, name, folder):
    import duckdb

    from helpers import canonical
    from siftline.plans import catalog_store  # noqa: F401
    from siftline.plans.catalog import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return canonical(QUERIES[name](spark, folder).toPandas().astype(object)) == canonical(con.sql(ORACLE[name]).df().astype(object))


def test_null_empty_and_blank_texts_of_delimited_files(spark, tmp_path):
    texts = [None, "", " ", "\n\t", " a　", "\x1cb\x1f ", " \x0bc\n", '"', 'd,"e"\r\n\nf', "-", "=", "\r"]
    assert same_as_sql(spark, "read_delimited_files", with_odd_rows(spark, tmp_path, texts))


def test_a_text_has_no_envelope_line(spark, tmp_path):
    texts = [None, "", "From x", "From x\n", "From x Mon Jan  1 00:00:00 2024", "Subject: a", "x\nTo:\tb", "Note:\n  prose", "x\rTo: b", "T:\x0b", "X" * 8190 + "\nTo: b", "é" * 8188 + "\nT:b"]
    assert same_as_sql(spark, "validate_record", with_odd_rows(spark, tmp_path, texts))

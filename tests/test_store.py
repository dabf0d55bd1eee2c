import random

from pyspark.sql import functions as F

from helpers import rows_of
from siftline.operators import ingest as G
from siftline.operators import report as RP
from siftline.operators import store as ST
from siftline.operators.ordered import running
from siftline.operators.skew import lookup
from siftline.session import scratch_path

OLD = "key string, seq long, first_seen timestamp, band string, score double, note string"


def registers(spark):
    old = spark.createDataFrame([("a", 1, None, "B", 61.0, "mine"), ("b", 4, None, "C", 45.0, "")], OLD)
    new = spark.createDataFrame([("a", 1, "A", 80.0), ("c", 2, "S", 95.0), ("c", 5, "A", 76.0), ("d", 3, "B", 60.0)], "key string, ord long, band string, score double")
    return old, new


def test_running_totals_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 50}", i, rng.randrange(100)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    got = {(r.k, r.i): (r.n, r.total) for r in running(df, ["i"], ["k"], sums={"total": "v"}, number="n").collect()}
    want, state = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        n, t = state.get(k, (0, 0))
        state[k] = want[(k, i)] = (n + 1, t + v)
    assert got == want
    whole = {r.i: r.n for r in running(df, ["i"], number="n").collect()}
    assert whole == {i: i + 1 for i in range(3000)}


def test_null_groups_keep_running_and_keep_their_first(spark):
    rows = [(None if i % 2 else "a", i, i % 10) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, i long, v long").repartition(4)
        got = {(r.k, r.i): r.n for r in running(df, ["i"], ["k"], number="n").collect()}
        assert got == {(None if i % 2 else "a", i): i // 2 + 1 for i in range(400)}
        firsts = G.dedupe_exact(df, "v", "i", ["k"]).filter("is_first").collect()
        assert sorted((r.k or "", r.i) for r in firsts) == [("", i) for i in range(1, 10, 2)] + [("a", i) for i in range(0, 10, 2)]
        files = df.selectExpr("cast(NULL AS string) AS batch_id", "i AS seq", "concat('f', i, '.eml') AS path", "10L AS size", "10L AS compressed_size", "cast(v AS string) AS sha256", "'From x' AS head")
        found = {r.seq: (r.nth, r.status) for r in G.admit_files(files).collect()}
        assert len(found) == 400 and all(n == i + 1 and s == ("accepted" if i < 10 else "duplicate") for i, (n, s) in found.items())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_lookup_equals_join(spark):
    left = spark.range(5000).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 3000) END").alias("k"))
    right = spark.range(2000).select(F.expr("CASE WHEN id = 0 THEN 'hot' ELSE concat('k', id) END").alias("k"), F.col("id").alias("v"), F.lit("x").alias("w"))
    assert rows_of(lookup(left, right, "k"), "id", "k", "v", "w") == rows_of(left.join(right, "k", "left"), "id", "k", "v", "w")
    numbers = left.select("id", F.expr("id % 10").alias("n"))
    table = spark.range(5).select(F.col("id").alias("n"), (F.col("id") * 2).alias("v"))
    assert rows_of(lookup(numbers, table, "n"), "id", "v") == rows_of(numbers.join(table, "n", "left"), "id", "v")


def test_upsert_keeps_what_is_protected(spark):
    old, new = registers(spark)
    out = ST.upsert_register(old, new, ["band", "score"], {"note": ""}, "2024-02-01 00:00:00")
    assert rows_of(out, "key", "seq", "band", "score", "note") == [
        ("a", 1, "A", 80.0, "mine"), ("b", 4, "C", 45.0, ""), ("c", 5, "A", 76.0, ""), ("d", 6, "B", 60.0, ""),
    ]


def test_upsert_twice_is_upsert_once(spark):
    old, new = registers(spark)
    columns = ("key", "seq", "first_seen", "band", "score", "note")
    once = ST.upsert_register(old, new, ["band", "score"], {"note": ""}, "2024-02-01 00:00:00")
    twice = ST.upsert_register(once, new, ["band", "score"], {"note": ""}, "2024-03-01 00:00:00")
    assert rows_of(once, *columns) == rows_of(twice, *columns)


def test_published_snapshots(spark):
    root = scratch_path(spark, "register")
    for version in (1, 2):
        ST.publish(spark.range(version), root, version)
    version, path = ST.published(spark, root)
    assert version == 2 and spark.read.parquet(path).count() == 2


def test_snapshot_diff(spark):
    wanted = spark.createDataFrame([("a", "S", "n"), ("b", "A", "n"), ("c", "B", "n")], "key string, band string, name string")
    existing = spark.createDataFrame(
        [("a", "S", "o", "1"), ("a", "A", "o", "0"), ("b", "S", "o", "2"), ("x", "S", "o", "3")], "key string, band string, name string, path string")
    assert rows_of(ST.snapshot_diff(wanted, existing), "key", "path", "action", "band") == [
        ("a", "0", "REMOVE_COPY", None), ("a", "1", "REFRESH", "S"), ("b", "2", "MOVE", "A"), ("c", None, "ADD", "B"), ("x", "3", "REMOVE", None),
    ]


def test_dedupe_prefers_complete_then_new(spark):
    rows = [(1, "a", "f", "x", None), (2, "a", "f", "x", "y"), (3, "a", "f", "x", "y"), (4, "", "f", None, None), (5, " ", "f", "x", None), (6, "b", "g", "", "")]
    table = spark.createDataFrame(rows, "id long, k string, fb string, p string, q string")
    assert rows_of(ST.dedupe_best_row(table, ["k"], ["fb"], ["p", "q"], "id"), "id") == [(3,), (5,), (6,)]


def test_stale(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id int")
    runs = spark.createDataFrame([(1, 1, "r1", "s1"), (1, 2, "r2", "s1"), (2, 3, "r1", "s1"), (3, 4, "r2", None)], "doc_id int, run_id int, rules string, score string")
    assert rows_of(ST.stale_documents(docs, runs, {"rules": "r2", "score": ""}), "doc_id", "stale") == [(1, False), (2, True), (3, False), (4, True)]
    assert rows_of(ST.stale_documents(docs, runs, {"rules": "r2", "score": "s1"}).filter("stale"), "doc_id") == [(2,), (3,), (4,)]


def test_reconcile(spark):
    files = spark.createDataFrame([(i, s, "") for i, s in enumerate(["accepted", "accepted", "completed", "accepted", "failed"])], "file_id int, status string, doc_id string")
    items = spark.createDataFrame([(1, 0, "COMPLETED", "d"), (2, 1, "DUPLICATE", ""), (3, 2, "RUNNING", ""), (4, 3, "FAILED", ""), (5, 4, "SKIPPED", "")],
                                  "item_id int, file_id int, status string, doc_id string")
    assert rows_of(ST.reconcile_items(files, items), "file_id", "status", "doc_id") == [
        (0, "completed", "d"), (1, "duplicate", ""), (2, "completed", ""), (3, "accepted", ""), (4, "accepted", ""),
    ]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.range(100).select("id", F.lit("x").alias("t"))
    prints = [ST.table_fingerprint(df).first().fingerprint for df in (a, a.orderBy(F.desc("id")), a.filter("id > 0"), a.unionByName(a.limit(1)))]
    assert prints[0] == prints[1] and len(set(prints)) == 3


def test_admission_reasons(spark):
    head = "From: a\n"
    rows = [("b", 1, "x/1.eml", 10, 10, "h1", head), ("b", 2, "x/2.eml", 10, 10, "h1", head), ("b", 3, "a/../b.eml", 1, 1, "h2", head), ("b", 4, "x/4.txt", 1, 1, "h3", head),
            ("b", 5, "x/5.eml", 999, 999, "h4", head), ("b", 6, "1/2/3/4.eml", 1, 1, "h5", head), ("b", 7, "x/7.eml", 60, 1, "h6", head), ("b", 8, "x/8.eml", 60, 60, "h7", head),
            ("b", 9, "x/9.eml", 5, 5, "h8", "no header"), ("b", 10, "x/10.eml", 5, 5, "h9", head), ("b", 11, "x/11.eml", 5, 5, "h10", head),
            ("c", 1, "1.eml", 1, 1, "h1", head), ("c", 2, "._2.eml", 1, 1, "h11", head)]
    files = spark.createDataFrame(rows, "batch_id string, seq long, path string, size long, compressed_size long, sha256 string, head string")
    limits = G.Limits(max_depth=2, max_file_size=500, max_total_size=100, max_ratio=10.0, max_files=8)
    history = spark.createDataFrame([("h9", "DUPLICATE_STORED")], "sha256 string, history string")
    got = {(r.batch_id, r.seq): r.reason for r in G.admit_files(files, limits, history).collect()}
    assert got == {
        ("b", 1): None, ("b", 2): "DUPLICATE_CONTENT", ("b", 3): "PARENT_TRAVERSAL", ("b", 4): "UNSUPPORTED_TYPE", ("b", 5): "FILE_TOO_LARGE",
        ("b", 6): "NESTING_DEPTH_EXCEEDED", ("b", 7): "COMPRESSION_RATIO_EXCEEDED", ("b", 8): "TOTAL_SIZE_EXCEEDED", ("b", 9): "TOTAL_SIZE_EXCEEDED",
        ("b", 10): "TOTAL_SIZE_EXCEEDED", ("b", 11): "MAX_FILES_EXCEEDED", ("c", 1): None, ("c", 2): "UNSUPPORTED_TYPE",
    }
    roomy = {(r.batch_id, r.seq): r.reason for r in G.admit_files(files, G.Limits(max_depth=2, max_file_size=500, max_ratio=10.0), history).collect()}
    assert roomy[("b", 9)] == "INVALID_MAIL" and roomy[("b", 10)] == "DUPLICATE_STORED" and roomy[("b", 11)] is None
    status = {r.batch_id: r.batch_status for r in G.batch_status(G.admit_files(files, limits, history)).collect()}
    assert status == {"b": "FAILED", "c": "READY"}


def test_parse_cache_parses_each_content_once(spark):
    atts = spark.createDataFrame([(1, "h1", "A"), (2, "h1", "A"), (3, "h2", "B"), (4, "h3", "C")], "att_id int, sha256 string, content string")
    atts = atts.withColumn("parser_version", F.lit("p")).withColumn("option_version", F.lit("o"))
    cache = spark.createDataFrame([("h2", "p", "o", "from cache"), ("h3", "old", "o", "stale")], "sha256 string, parser_version string, option_version string, text string")
    out, fresh = G.reuse_parse_cache(atts, cache, "lower(content)")
    assert rows_of(out, "att_id", "text", "cache_hit") == [(1, "a", False), (2, "a", False), (3, "from cache", True), (4, "c", False)]
    assert rows_of(fresh, "sha256", "text") == [("h1", "a"), ("h3", "c")]
    again, none = G.reuse_parse_cache(atts, cache.unionByName(fresh), "lower(content)")
    assert none.count() == 0 and {r.cache_hit for r in again.collect()} == {True}


def test_combined_text(spark):
    cell = "struct<sheet:string,row:int,col:int,value:string>"
    rows = [("body", [("n.csv", "a | b", [("csv", 1, 1, "a"), ("csv", 1, 2, "b")]), ("e.txt", " ", [])])]
    df = spark.createDataFrame(rows, f"body string, att array<struct<filename:string,text:string,cells:array<{cell}>>>")
    assert df.select(F.expr(G.combined_text("body", "att", 1))).first()[0] == "body\n\n\n===== n.csv =====\na | b\n\n\n===== n.csv cells =====\n[csv r1c1] a"


def test_pages_near_and_deep_agree(spark, monkeypatch):
    listing = spark.range(500).selectExpr(
        "id AS doc_id", "CASE id % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'B' WHEN 2 THEN 'D' END AS band", "cast(id % 7 AS double) AS score",
        "timestamp_seconds(id) AS processed_at", "CASE WHEN id % 11 = 0 THEN 'PRIORITY' END AS review_status",
    )
    near = [[r.doc_id for r in RP.paginate(listing, p, 60, True).collect()] for p in (1, 4, 9, 99)]
    monkeypatch.setattr(RP, "DIRECT_PAGE_ROWS", 0)
    deep = [[r.doc_id for r in RP.paginate(listing, p, 60, True).collect()] for p in (1, 4, 9, 99)]
    assert near == deep and len(near[2]) == 20 and near[2] == near[3]

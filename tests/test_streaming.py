from pyspark.sql import functions as F

from helpers import rows_of
from siftline.session import scratch_path
from siftline.streaming import jobs as J

SCHEMA = "doc_id long, text string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_triage(spark):
    inbox, register, checkpoint = (scratch_path(spark, n) for n in ("inbox", "register", "checkpoint"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def analyse(batch):
        return batch.select("doc_id", F.length("text").alias("n"), F.expr("CASE WHEN text = 'bad' THEN 'failed' ELSE 'completed' END").alias("status"))

    def run():
        stream = J.stream_table(spark, inbox, schema)
        J.run_to_end(J.incremental_triage(stream, analyse, register, checkpoint, "status = 'completed'"))

    put(spark, inbox, [(1, "a"), (1, "a"), (2, "bad"), (3, "ccc")])
    run()
    assert rows_of(J.current_register(spark, register), "doc_id", "n", "status") == [(1, 1, "completed"), (2, 3, "failed"), (3, 3, "completed")]
    run()  # nothing new, nothing done
    assert spark.read.parquet(register).count() == 3
    put(spark, inbox, [(1, "changed"), (2, "good now"), (4, "dddd")])
    run()
    assert rows_of(J.current_register(spark, register), "doc_id", "n", "status") == [
        (1, 1, "completed"), (2, 8, "completed"), (3, 3, "completed"), (4, 4, "completed"),
    ]
    # a finished document was not analysed again, the failed one was
    assert spark.read.parquet(register).count() == 5


def test_a_new_checkpoint_keeps_what_is_registered(spark):
    inbox, register = scratch_path(spark, "inbox"), scratch_path(spark, "register")
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(checkpoint):
        stream = J.stream_table(spark, inbox, schema)
        J.run_to_end(J.incremental_triage(stream, lambda b: b.select("doc_id", "text"), register, checkpoint, version="text"))

    put(spark, inbox, [(1, "a"), (2, "b"), (2, "c")])
    run(scratch_path(spark, "checkpoint"))
    put(spark, inbox, [(3, "d")])
    second = scratch_path(spark, "checkpoint")
    run(second)
    assert rows_of(J.current_register(spark, register), "doc_id", "text") == [(1, "a"), (2, "c"), (3, "d")]
    put(spark, inbox, [(4, "e")])
    run(second)
    assert rows_of(J.current_register(spark, register), "doc_id", "text") == [(1, "a"), (2, "c"), (3, "d"), (4, "e")]
    assert spark.read.parquet(register).count() == 4


def test_sessions(spark):
    rows = [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:29:59"), ("a", "2024-01-01 11:00:00"), ("b", "2024-01-01 10:10:00")]
    got = J.session_activity(spark.createDataFrame(rows, "user string, ts string"), "ts", "user")
    assert sorted((r.user, r.n) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def in_files(spark, folder, df, parts):
    """The rows of each part in a file of its own, in order."""
    for where in parts:
        df.filter(where).coalesce(1).write.mode("append").parquet(folder)


def test_failed_analyses_are_tried_again(spark):
    inbox, register = scratch_path(spark, "inbox"), scratch_path(spark, "register")
    schema = spark.createDataFrame([], SCHEMA).schema

    def analyse(batch):
        ok = "CASE WHEN text = 'never' OR (text = 'later' AND attempt < 2) THEN 'failed' ELSE 'completed' END"
        return batch.select("doc_id", "text", "attempt", F.expr(ok).alias("status"))

    def run(checkpoint):
        stream = J.stream_table(spark, inbox, schema, files_per_batch=1)
        J.run_to_end(J.incremental_triage(stream, analyse, register, checkpoint, "status = 'completed'", retries=3, buckets=4))

    first = scratch_path(spark, "checkpoint")
    for rows in ([(1, "a"), (2, "later"), (3, "never")], [(4, "b")], [(5, "c"), (1, "again")]):
        put(spark, inbox, rows)
        run(first)
    assert rows_of(J.current_register(spark, register), "doc_id", "attempt", "status") == [
        (1, 0, "completed"), (2, 2, "completed"), (3, 2, "failed"), (4, 0, "completed"), (5, 0, "completed"),
    ]
    # a lost checkpoint: all comes in once more, only what failed is done again
    before = spark.read.parquet(register).count()
    run(scratch_path(spark, "checkpoint"))
    got = rows_of(J.current_register(spark, register), "doc_id", "attempt", "status")
    assert [g[0] for g in got if g[2] == "failed"] == [3] and spark.read.parquet(register).count() <= before + 2
    assert spark.read.parquet(register).filter("doc_id = 1").count() == 1


def test_a_batch_reads_its_own_buckets_only(spark):
    inbox, register, checkpoint = (scratch_path(spark, n) for n in ("inbox", "register", "checkpoint"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        stream = J.stream_table(spark, inbox, schema)
        J.run_to_end(J.incremental_triage(stream, lambda b: b.select("doc_id", "text"), register, checkpoint, buckets=16))

    put(spark, inbox, [(i, str(i)) for i in range(200)])
    run()
    put(spark, inbox, [(7, "x"), (1000, "new")])
    # the other buckets may be broken: this batch does not look at them
    own = {r[0] for r in spark.createDataFrame([(7,), (1000,)], "doc_id long").select(J._bucket("doc_id", 16)).collect()}
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(register).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in J._folders(spark, register):
        if int(name.split("=")[1]) not in own:
            fs.create(jvm.Path(f"{register}/{name}/batch=0/part-broken.parquet")).close()
    run()
    table = spark.read.option("basePath", register).parquet(*(f"{register}/bucket={b}" for b in own))
    assert table.filter("doc_id IN (7, 1000)").count() == 2 and table.filter("batch = 1").count() == 1


def test_counts_of_several_batches_and_late_rows(spark):
    rows = [(i, f"2024-01-{d:02d} {h:02d}:00:00", "ab"[i % 2]) for i, (d, h) in enumerate([(1, 1), (1, 5), (2, 3), (1, 20), (5, 0), (4, 2), (3, 0), (1, 0), (6, 1)])]
    events = spark.createDataFrame(rows, "event_id int, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    inbox, path, checkpoint = (scratch_path(spark, n) for n in ("events", "counts", "checkpoint"))
    in_files(spark, inbox, events, ["event_id < 3", "event_id BETWEEN 3 AND 4", "event_id BETWEEN 5 AND 7", "event_id > 7"])
    stream = J.stream_table(spark, inbox, events.schema, files_per_batch=1)
    J.run_to_end(J.count_windows(stream, "ts", ["kind"], path, checkpoint, "1 day"))
    # behind 5 January by more than a day: 3 January and 1 January
    assert rows_of(J.late_rows(spark, path), "event_id") == [(6,), (7,)]
    columns = ("window_start", "window_end", "kind", "n")
    on_time = events.filter("event_id NOT IN (6, 7)")
    assert rows_of(J.counted_windows(spark, path), *columns) == rows_of(J.daily_counts(on_time, "ts", ["kind"]), *columns)


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{path}/events.parquet")
    stream = J.stream_table(spark, path, events.schema, "events.parquet")
    columns = ("window_start", "window_end", "event_type", "n")
    for more in ({}, {"slide": "1 day", "width": "7 days"}):
        out = scratch_path(spark, "counts")
        J.run_to_end(J.count_windows(stream, "ts", ["event_type"], out, scratch_path(spark, "checkpoint"), **more))
        assert rows_of(J.counted_windows(spark, out), *columns) == rows_of(J.daily_counts(events, "ts", ["event_type"], **more), *columns)


def test_dedupe_drops_history(spark):
    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{path}/events.parquet").select("event_id", "ts", "user_id")
    inbox, seen, out, checkpoint = (scratch_path(spark, n) for n in ("events", "seen", "unique", "checkpoint"))
    events.filter("user_id < 3").select("user_id", "ts").coalesce(1).write.parquet(seen)
    in_files(spark, inbox, events, ["day(ts) <= 10", "day(ts) BETWEEN 11 AND 20", "day(ts) > 20"])
    stream = J.stream_table(spark, inbox, events.schema, files_per_batch=1)
    history = J.stream_table(spark, seen, spark.read.parquet(seen).schema)
    J.run_to_end(J.write_table(J.stream_dedupe(stream, "user_id", "ts", "60 days", history), out, checkpoint))
    first = events.filter("user_id >= 3").groupBy("user_id").agg(F.min("ts").alias("ts"))
    assert rows_of(spark.read.parquet(out), "user_id", "ts") == rows_of(first, "user_id", "ts")


def test_state_of_deduplication_stays_flat(spark):
    """A new key every day for thirty days, with a delay of two: the state holds a few keys, not thirty."""
    days = spark.range(1, 31).selectExpr("id AS user_id", "timestamp_seconds(1704067200 + id * 86400) AS ts")
    inbox, seen, out, checkpoint = (scratch_path(spark, n) for n in ("events", "seen", "unique", "checkpoint"))
    days.filter("false").write.parquet(seen)
    in_files(spark, inbox, days, [f"user_id = {d}" for d in range(1, 31)])
    stream, history = (J.stream_table(spark, f, days.schema, files_per_batch=1) for f in (inbox, seen))
    query = J.write_table(J.stream_dedupe(stream, "user_id", "ts", "2 days", history), out, checkpoint)
    J.run_to_end(query)
    assert spark.read.parquet(out).count() == 30
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 8


def test_keys_of_one_bucket_are_told_apart(spark):
    """Three entries of the state for ten keys; large ids come back whole, and a null key is one key."""
    big = 2**62 + 1
    rows = [(big + i, None if i == 9 else f"k{i}", f"2024-01-{d:02d} 00:00:00") for d in (1, 2, 20, 30) for i in range(10) if d != 20 or i < 2]
    events = spark.createDataFrame(rows, "event_id long, name string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    inbox, seen, out, checkpoint = (scratch_path(spark, n) for n in ("events", "seen", "unique", "checkpoint"))
    events.filter("name = 'k3' AND day(ts) = 1").select("name", "ts").coalesce(1).write.parquet(seen)
    in_files(spark, inbox, events, [f"day(ts) = {d}" for d in (1, 2, 20, 30)])
    stream = J.stream_table(spark, inbox, events.schema, files_per_batch=1)
    history = J.stream_table(spark, seen, spark.read.parquet(seen).schema)
    query = J.write_table(J.stream_dedupe(stream, "name", "ts", "15 days", history, buckets=3), out, checkpoint)
    J.run_to_end(query)
    got = rows_of(spark.read.parquet(out).selectExpr("event_id", "name", "day(ts) AS day"), "event_id", "name", "day")
    first = [(big + i, None if i == 9 else f"k{i}", 1) for i in range(10) if i != 3]
    # on the 30th the watermark stands at the 5th: nobody's time is over
    assert got == sorted(first, key=repr)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3

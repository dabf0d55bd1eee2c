import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from siftline.operators.keyed import KeyedTable
from siftline.operators.store import insert_or_replace
from siftline.session import scratch_path


def merge(old, new):
    return insert_or_replace(old, new, ["key"], "ord")


def table_of(spark, n=1000):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), "cast(key div 10 as int)")
    table.create(spark.range(n).selectExpr("id AS key", "0 AS ord", "cast(id AS string) AS value"))
    return table


def test_an_upsert_rewrites_its_buckets_only(spark):
    table = table_of(spark)
    new = spark.createDataFrame([(k, 1, "new") for k in (500, 505, 507, 1003)], "key long, ord int, value string")
    assert table.upsert(new, merge) == [50, 100]
    assert table.changed(1) == [50, 100]
    got = {r.key: r.value for r in table.read().collect()}
    assert len(got) == 1001 and {k for k, v in got.items() if v == "new"} == {500, 505, 507, 1003}
    # of a hundred buckets two are in the new version's folder
    assert len([n for n in table._names("data/0000000002") if n.startswith("_bucket")]) == 2
    assert sorted(r.key for r in table.read(1).collect()) == list(range(1000))
    assert {r.key for r in table.read(buckets=table.changed(1)).collect()} == {*range(500, 510), 1003}


def test_a_crash_before_the_commit_leaves_the_old_version(spark, monkeypatch):
    table = table_of(spark, 50)
    new = spark.createDataFrame([(7, 1, "new")], "key long, ord int, value string")

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(KeyedTable, "_commit", crash)
        with pytest.raises(OSError):
            table.upsert(new, merge)
    assert table.commit_of()["version"] == 1 and table.read().filter("value = 'new'").count() == 0
    # a commit that was begun and not finished is no commit
    path, fs = table._fs("commits/0000000002.json")
    fs.create(path, False).close()
    assert table.commit_of()["version"] == 1
    fs.delete(path, False)
    table.upsert(new, merge)
    assert table.commit_of()["version"] == 2 and table.read().filter("value = 'new'").count() == 1


def test_two_writers_of_one_version(spark):
    table = table_of(spark, 20)
    with pytest.raises(Exception, match="exists"):
        table._commit(1, table.read().schema, {})


def test_empty_buckets_and_hash_buckets(spark):
    table = KeyedTable.by_hash(spark, scratch_path(spark, "keyed"), "key", 8)
    with pytest.raises(ValueError):
        table.read()
    table.create(spark.range(100).selectExpr("id AS key", "0 AS ord"))
    table.upsert(spark.range(100).selectExpr("id AS key", "1 AS ord"), lambda old, new: old.join(new, "key", "left_semi").filter("key = 3"))
    assert rows_of(table.read(), "key", "ord") == [(3, 0)]
    table.upsert(spark.range(0).selectExpr("id AS key", "1 AS ord"), lambda old, new: old.unionByName(new))
    assert table.read().agg(F.count("*")).first()[0] == 1

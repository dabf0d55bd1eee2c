"""Every query with an SQL equivalent gives the same rows as that SQL."""

import duckdb
import pytest

import __spark_entry__
from helpers import TABLES, canonical

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF_DIR).toPandas()
    want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())))
def test_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert {"doc_id", "score", "band"} <= set(out.columns) and out.count() == 200

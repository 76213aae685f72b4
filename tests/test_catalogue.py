"""Every query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from palimpsest.operators import retention, transactions
from palimpsest.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(map(str, pdf.where(pdf.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


LOG = "key string, version long, value string, meta int, expires_at long"


def left_over(spark, given, discard_ts, n=1, overlap=False):
    log = spark.createDataFrame([(k, v, "x", m, 0) for k, v, m in given], LOG)
    return sorted((r.key, r.version) for r in retention.compact(log, discard_ts, n, overlap).collect())


def test_retention_states(spark):
    top = 2**62
    assert left_over(spark, [("foo", 4, 0), ("foo", 3, 0), ("fooz", 1, 0)], top) == [("foo", 4), ("fooz", 1)]
    assert left_over(spark, [("foo", 3, 1), ("foo", 2, 0), ("fooz", 1, 1)], top) == []
    assert left_over(spark, [("foo", 3, 1), ("foo", 2, 0), ("fooz", 1, 1)], top, overlap=True) == [("foo", 3), ("fooz", 1)]
    assert left_over(spark, [("foo", 3, 0), ("foo", 2, 0), ("foo", 1, 0)], top, n=2) == [("foo", 2), ("foo", 3)]
    assert left_over(spark, [("foo", 9, 1), ("foo", 2, 0), ("foo", 1, 0)], 5) == [("foo", 2), ("foo", 9)]
    assert left_over(spark, [], 5) == []


def test_commit_outcomes_follow_a_fold(spark):
    edges = [(2, 1), (3, 2), (4, 3), (4, 1), (6, 5), (7, 6)]
    committed = set()
    for t in range(1, 9):
        if not any(o in committed for x, o in edges if x == t):
            committed.add(t)
    txns = spark.createDataFrame([(t,) for t in range(1, 9)], "txn long")
    got = transactions.outcomes(txns, spark.createDataFrame(edges, "txn long, other long"), lambda d: d.cache())
    assert {r.txn for r in got.collect() if r.outcome == "committed"} == committed

"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from strideframe.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = ("customer", "events", "embeddings", "labels", "lineitem", "orders", "part")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.apply(lambda c: c.round(6) if c.dtype.kind == "f" else c)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = rows(catalogue.queries()[name](spark, DIR).toPandas())
    want = rows(db.sql(catalogue.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert ((got[c] == want[c]) | ((got[c] - want[c]).abs() < 2e-6 if got[c].dtype.kind == "f" else False)).all(), c


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0

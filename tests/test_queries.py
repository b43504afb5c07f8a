"""Every query of the driver's contract against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def test_names():
    from sigweave.plans import file_queries, queries as own

    assert set(own.QUERIES) == set(own.ORACLES) and set(file_queries.QUERIES) == set(file_queries.ORACLES) and set(own.QUERIES) | set(file_queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DIR):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    got, want = entry.queries()[name](spark, DIR).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in cols)

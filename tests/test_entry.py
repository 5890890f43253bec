"""Driver contract: entry smoke, query/oracle key alignment, DuckDB match at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as se
from __spark_entry__ import QUERIES
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["Universe", "Ticker", "gap_start", "gap_end", "gap_days"]
    assert df.count() > 0


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(se.queries())
    assert set(QUERIES) <= set(se.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, con, name):
    s_df = se.queries()[name](spark, SF)
    s = s_df.toPandas()
    d = con.execute(se.oracle_sql()[name]).df()
    assert sorted(s_df.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert digest(s) == digest(d)

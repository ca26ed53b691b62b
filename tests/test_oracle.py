"""Every registered query against its DuckDB oracle (row count, column names, values) on the
smallest fixture; queries without an oracle must at least run."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, fingerprint

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cols = list(df.columns)
    if name not in ORACLE:
        assert len(cols) > 0
        return
    cur = con.execute(ORACLE[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert fingerprint(rows, cols) == fingerprint(drows, dcols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "recommended_model" in df.columns

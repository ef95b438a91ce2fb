"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, float) else str(v)[:19]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    got = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=str)
    at = [cols.index(c) for c in order]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in cur.fetchall()], key=str)


def test_queries_without_sql_have_rows(spark):
    for name in ("wavelet", "fourier", "density_drift", "mutual_information", "orderbook_summary"):
        assert QUERIES[name](spark, SF).count() > 0

"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tallgene.plans.bind import RAW

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = {name: fn for name, fn in entry.queries().items() if name not in entry.LLM_QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    return v + 0.0 if isinstance(v, float) else v


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical(df.columns, got) == canonical(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

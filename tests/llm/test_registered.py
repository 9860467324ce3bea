"""The registered queries: one for each operator and the pipeline, and those with an SQL twin against it."""

import duckdb
import pytest

import __spark_entry__ as entry
from tallgene.llm import queries

DATA = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert sorted(n.split("_")[0] for n in entry.LLM_QUERIES) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
    assert set(entry.LLM_QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, want.fetchall()))

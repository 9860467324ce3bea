"""Draws at large rates, groups without a name, cells spread over shards."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallgene.functions.ranks import hash_ranks, quantiles, value_ranks
from tallgene.operators import samples as sm
from tallgene.operators import sampling as sp
from tallgene.streaming import jobs


@pytest.mark.parametrize("rate", [0.5, 30.0, 399.0, 760.0, 1000.0, 10_000.0])
def test_poisson_mean_and_variance(spark, rate):
    draws = spark.range(1000).select(sm.poisson(F.lit(rate), (F.col("id") + 0.5) / 1000).alias("k"))
    mean, var = draws.agg(F.avg("k"), F.var_pop("k")).first()
    assert mean == pytest.approx(rate, rel=2e-3, abs=2e-3) and var == pytest.approx(rate, rel=0.02)


@pytest.mark.parametrize("n, p", [(1, 0.3), (50, 0.9), (1000, 0.33), (10_000, 0.33), (10_000, 0.97), (100_000, 0.5)])
def test_binomial_mean_and_variance(spark, n, p):
    draws = spark.range(1000).select(sm.binomial(F.lit(float(n)), F.lit(p), (F.col("id") + 0.5) / 1000).alias("k"))
    mean, var, low, high = draws.agg(F.avg("k"), F.var_pop("k"), F.min("k"), F.max("k")).first()
    assert mean == pytest.approx(n * p, rel=2e-3, abs=2e-3) and var == pytest.approx(n * p * (1 - p), rel=0.02)
    assert 0 <= low and high <= n


def test_binomial_edges(spark):
    edges = spark.createDataFrame([(0.0, 0.5), (7.0, 0.0), (7.0, 1.0)], "n double, p double")
    assert [r[0] for r in edges.select(sm.binomial(F.col("n"), F.col("p"), F.lit(0.4))).collect()] == [0, 0, 7]


def test_null_groups_stay(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"g{i % 2}", float(i)) for i in range(30)], "id long, g string, v double")
    ranks = hash_ranks(rows, ["g"], 1, ["id"], "rn", "total").collect()
    assert len(ranks) == 30 and sorted(r["rn"] for r in ranks if r["g"] is None) == list(range(1, 11))
    assert {r["g"]: r["m"] for r in quantiles(rows, ["g"], "v", {"m": 0.5}).collect()} == {None: 13.5, "g0": 15.0, "g1": 15.0}
    assert value_ranks(rows, ["g"], "v").where("g IS NULL").count() == 10
    assert sp.sample_upto_n_per_group(rows.select("id", "g"), 4, "g", ["id"]).groupBy("g").count().where("count = 4").count() == 3


def test_cell_spread_over_shards(spark, tmp_path):
    var = spark.createDataFrame([("a", False), ("m", True)], "gene string, mito boolean")
    for i, row in enumerate([("c", "a", 1.0), ("c", "m", 5.0)]):
        spark.createDataFrame([row], "cell_id string, gene string, value double").write.mode("append").parquet(f"{tmp_path}/in")
    got = jobs.ingest_qc(spark, f"{tmp_path}/in", "cell_id string, gene string, value double", var, f"{tmp_path}/out", f"{tmp_path}/ckpt", 1).collect()
    assert [(r["total_counts"], r["n_genes_by_counts"], r["total_counts_mt"]) for r in got] == [(6.0, 2, 5.0)]
    assert got[0]["pct_counts_mt"] == pytest.approx(500 / 6)


def test_no_language_vanishes(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for f in os.listdir(source):
        if f != "documents.parquet":
            os.symlink(f"{source}/{f}", tmp_path / f)
    docs = spark.read.parquet(f"{source}/documents.parquet")
    lang = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "").when(F.col("doc_id") % 5 == 2, "a/b").when(F.col("doc_id") % 5 == 3, "null").otherwise(F.col("lang"))
    docs.withColumn("lang", lang).toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    for f in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tmp_path}/{f}'")
    got = entry.queries()["src_dna_csv"](spark, str(tmp_path)).select("sequence", "label", "split").collect()
    want = con.execute(f"SELECT sequence, label, split FROM ({entry.oracle_sql()['src_dna_csv']})").fetchall()
    assert {None, "", "a/b", "null"} < {r[2] for r in want}
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)

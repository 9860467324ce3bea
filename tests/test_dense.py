"""Dense rows and batchwise padding exchange entries, not dense rows."""

import re

import pytest
from pyspark.sql import functions as F

from tallgene.functions import lists
from tallgene.operators import filters
from tallgene.operators import samples as sm

ROWS = "cell_id string, batch_id long, gene string, pos int, value double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [4096, 5])
def test_dense_rows_keep_repeated_and_null_keys(spark, piece, monkeypatch):
    monkeypatch.setattr(lists, "PIECE", piece)
    expr = spark.createDataFrame([("a", "g1", 1.0), ("a", "g1", 2.0), ("a", "other", 3.0), ("b", "g2", None), (None, "g3", 4.0), ("a", None, 5.0)], "cell_id string, gene string, value double")
    cells = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "cell_id string")
    genes = spark.sql("SELECT concat('g', id % 12) AS gene FROM range(24) UNION ALL SELECT NULL")
    dense = filters.dense_rows(expr, cells, genes)
    want = cells.crossJoin(genes.where("gene IS NOT NULL").distinct()).join(expr, ["cell_id", "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    assert sorted(map(str, dense.collect())) == sorted(map(str, want.collect())) and dense.columns == want.columns
    assert not re.search(r"hashpartitioning\(cell_id#\d+, gene#", _plan(dense))


def test_padding_by_batch_exchanges_no_dense_rows(spark):
    cells = spark.range(40).select(F.col("id").cast("string").alias("cell_id"))
    expr = spark.range(200).select((F.col("id") % 40).cast("string").alias("cell_id"), F.concat(F.lit("g"), F.col("id") * 7 % 25).alias("gene"), F.lit(1.0).alias("value"))
    genes = spark.range(25).select(F.concat(F.lit("g"), "id").alias("gene"))
    rows = sm.item_rows(sm.build_samples(filters.dense_rows(expr, cells, genes))).withColumn("batch_id", F.floor(F.col("cell_id").cast("long") / 4))
    out = sm.pad_batchwise(rows, 14)
    assert not re.search(r"hashpartitioning\((cell_id#\d+, gene#|batch_id#\d+L?, gene#)", _plan(out))
    assert out.groupBy("cell_id").count().where("count <> 14").count() == 0 and out.count() == 40 * 14


def test_padding_with_null_keys_and_cells_of_two_batches(spark):
    rows = [("c", 1, "a", 0, 1.0), ("c", 2, "b", 1, 0.0), ("c", 1, "z", 2, 0.0), ("c", 1, None, 3, 0.0), ("d", 2, "b", 0, 2.0), ("d", None, "a", 1, 0.0),
            ("e", 1, "z", 0, 5.0), (None, 1, "z", 0, 0.0), (None, 1, "q", 1, 0.0), (None, 2, "b", 2, 3.0)]
    got = {(r["cell_id"], r["gene"]): r["pos"] for r in sm.pad_batchwise(spark.createDataFrame(rows, ROWS), 9).collect()}
    assert len(got) == 10 and got["c", "a"] == 0 and {got["c", "b"], got["c", "z"]} == {1, 2} and got["c", None] == 3
    assert got["d", "b"] == 0 and got["d", "a"] == 1 and got[None, "b"] == 0 and got[None, "z"] == 1 and got[None, "q"] == 2


def test_search_in_sorted_arrays(spark, monkeypatch):
    monkeypatch.setattr(lists, "SHORT", -1)
    for size in (0, 1, 2, 7, 8, 9):
        df = spark.range(20).select("id", F.array(*[F.lit(2 * i).cast("long") for i in range(size)]).cast("array<long>").alias("v"))
        hits = df.withColumn("s", lists.halving_steps(F.col("v"))).where(lists.in_sorted(F.col("v"), F.col("s"), F.col("id"))).select("id").collect()
        assert sorted(r["id"] for r in hits) == [2 * i for i in range(size)]

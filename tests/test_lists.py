"""Rows beside the items of a list of any length."""

import pytest
from pyspark.sql import functions as F

from tallgene.functions import lists
from tallgene.operators import filters, normalise, perturb, stats


@pytest.mark.parametrize("piece", [4096, 7])
def test_every_row_meets_every_item(spark, piece, monkeypatch):
    monkeypatch.setattr(lists, "PIECE", piece)
    rows = spark.range(13).withColumnRenamed("id", "cell_id")
    items = spark.sql("SELECT concat('g', id % 40) AS gene, id AS value FROM range(60) UNION ALL SELECT NULL, 1")
    got = [r["gene"] for r in lists.beside(rows, items, "gene", distinct=True).where("cell_id = 5").collect()]
    assert sorted(got) == sorted(f"g{i}" for i in range(40))
    assert lists.beside(rows, items, "gene", "value").count() == 13 * 61
    assert lists.beside(rows, items.limit(0), "gene").count() == 0 and lists.beside(rows.limit(0), items, "gene").count() == 0


def test_six_hundred_thousand_genes(spark):
    """Longer than any list that once was carried as one value."""
    n = 600_000
    genes = spark.range(n).select(F.concat(F.lit("g"), F.col("id")).alias("gene"))
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    expr = spark.createDataFrame([("a", "g5", 2.0), ("b", "g599999", 3.0)], "cell_id string, gene string, value double")
    dense = filters.dense_rows(expr, cells, genes)
    assert dense.agg(F.count("*"), F.sum("value"), F.count_distinct("gene")).first()[:] == (2 * n, 5.0, n)
    fill = genes.select("gene", F.lit(1.5).alias("baseline"))
    out = normalise.replace_noise_with_baseline(expr, cells, fill, threshold=2.0)
    assert out.agg(F.count("*"), F.sum("value")).first()[:] == (2 * n, 1.5 * 2 * n)
    paired = spark.createDataFrame([("a", "g1", 1.0, 0.0, 1)], "cell_id string, gene string, label double, control double, perturbed int")
    assert perturb.expose_zeros(paired, "all", genes, cells).agg(F.count("*"), F.sum("label")).first()[:] == (2 * n, 1.0)


def test_pieces_meet_by_an_equi_join(spark, monkeypatch):
    monkeypatch.setattr(lists, "PIECE", 7)
    plan = lists.beside(spark.range(9), spark.range(100).withColumnRenamed("id", "gene"), "gene")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_distance_of_profiles_counts_absent_genes(spark):
    rows = [("Control", "a", 1.0), ("Control", "b", 2.0), ("p", "a", 2.0), ("p", "c", 5.0), ("q", "a", 1.0), ("q", "b", 2.0), ("flat", "a", 0.0)]
    got = {r["perturbation"]: r["distance"] for r in stats.perturbation_distance(spark.createDataFrame(rows, "perturbation string, gene string, mean double")).collect()}
    assert got["q"] == pytest.approx(0.0) and got["flat"] is None and got["p"] == pytest.approx(1.9933992677987828)

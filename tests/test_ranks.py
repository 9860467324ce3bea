"""Bucketed ranks and quantiles against brute force, with one value or group holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallgene.functions import rand, ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(3000), "g": rng.choice(list("abcd"), 3000), "v": np.round(rng.lognormal(0, 3, 3000), 3)})
    pdf.loc[:999, "g"] = "hot"
    pdf.loc[500:1499, "v"] = 7.0
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_quantiles_by_group(skewed):
    pdf, df = skewed
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in ranks.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], part["v"].quantile([0.1, 0.5, 0.93]).to_numpy())


def test_global_quantile_is_a_scalar(skewed):
    pdf, df = skewed
    q = ranks.global_quantiles(df, "v", {"m": 0.5, "x": 0.99})
    row = df.select(q["m"].alias("m"), q["x"].alias("x")).first()
    assert np.allclose([row["m"], row["x"]], pdf["v"].quantile([0.5, 0.99]))


def test_value_ranks_match_average_rank(skewed):
    pdf, df = skewed
    out = ranks.value_ranks(df, ["g"], "v").withColumn("r", F.col("n_before") + (F.col("n") + 1) / 2).toPandas()
    want = pdf.assign(r=pdf.groupby("g")["v"].rank())[["g", "v", "r"]].drop_duplicates()
    merged = out.merge(want, on=["g", "v"], suffixes=("", "_w"))
    assert len(merged) == len(want) and np.allclose(merged["r"], merged["r_w"])


def test_hash_ranks_number_every_group(skewed):
    _, df = skewed
    out = ranks.hash_ranks(df, ["g"], 3, ["id"]).toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part["rn"]) == list(range(1, len(part) + 1))


def test_hash_ranks_do_not_depend_on_partitions(skewed):
    _, df = skewed
    a = {r["id"]: r["rn"] for r in ranks.hash_ranks(df.repartition(3), ["g"], 3, ["id"]).collect()}
    b = {r["id"]: r["rn"] for r in ranks.hash_ranks(df.repartition(11, "v"), ["g"], 3, ["id"]).collect()}
    assert a == b


def test_take_by_hash_is_exact(skewed):
    _, df = skewed
    assert ranks.take_by_hash(df, 1234, 1, ["id"]).count() == 1234


def test_hash_uniform_is_uniform(spark):
    u = spark.range(20000).select(rand.hash_uniform(5, "id").alias("u"))
    row = u.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg((F.col("u") < 0.25).cast("int"))).first()
    assert abs(row[0] - 0.5) < 0.01 and row[1] >= 0 and row[2] < 1 and abs(row[3] - 0.25) < 0.01


def test_many_buckets_give_the_same_ranks(skewed):
    pdf, df = skewed
    out = ranks.value_ranks(df, ["g"], "v", {"s": F.col("id")}).toPandas()
    for g, part in pdf.groupby("g"):
        mine = out[out["g"] == g].sort_values("v")
        by_value = part.groupby("v")["id"].agg(["count", "sum"]).sort_index()
        assert list(mine["n_before"]) == list(by_value["count"].cumsum().shift(fill_value=0))
        assert list(mine["s_before"]) == list(by_value["sum"].cumsum().shift(fill_value=0))
    q = ranks.global_quantiles(df, "v", {"m": 0.37})
    assert np.allclose(df.select(q["m"]).first()[0], pdf["v"].quantile(0.37))


def test_empty_table(spark):
    df = spark.range(0).select(F.col("id").cast("double").alias("v"))
    assert ranks.quantiles(df, [], "v", {"q": 0.5}).first()["q"] is None


def test_constant_column(spark):
    df = spark.range(10).select(F.lit(4.0).alias("v"))
    assert ranks.quantiles(df, [], "v", {"q": 0.3}).first()["q"] == 4.0


def test_hot_label_splits_exactly(spark):
    """A label with most of the rows: exact shares per label, and the same split whatever the partitions."""
    from tallgene.operators import sampling as sp

    df = spark.range(6000).select("id", F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 4).cast("string"))).alias("lab"))
    w = {"train": 0.7, "dev": 0.1, "test": 0.2}
    one = sp.stratified_split(df.repartition(5), "lab", w, ["id"])
    two = sp.stratified_split(df.repartition(3, "lab"), "lab", w, ["id"])
    assert {(r["id"], r["split"]) for r in one.collect()} == {(r["id"], r["split"]) for r in two.collect()}
    n = {(r["lab"], r["split"]): r["count"] for r in one.groupBy("lab", "split").count().collect()}
    assert n[("hot", "test")] == 800 and n[("hot", "dev")] == 400 and n[("l1", "test")] == 100


def test_hot_name_gets_all_suffixes(spark):
    from tallgene.operators import setops as so

    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string")).alias("c"), F.lit("p").alias("pre"))
    out = so.unique_cells(df, "pre", "c", "id")
    assert out.select("cell_name").distinct().count() == 900
    assert out.where("id = 897").first()["cell_name"] == "p_x-299"


@pytest.mark.parametrize("bound", [1 << 16, 40, 3])
def test_values_are_cut_by_their_order(skewed, spark, bound, monkeypatch):
    monkeypatch.setattr(ranks, "BOUND", bound)
    pdf, df = skewed
    odd = [-1e300, -2.0, -1e-320, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 2.0, 1.9999999999999998, 1e300, float("inf"), float("-inf"), float("nan")]
    rows = [(i, g, float(v)) for i, (g, v) in enumerate([*zip(pdf["g"], pdf["v"], strict=True), *(("a", v) for v in odd), *((None, v / 7) for v in range(-300, 300))])]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    for by in (["g"], []):
        got = ranks.value_ranks(df, by, "v", {"ids": F.col("id")}).collect()
        groups = {}
        for i, g, v in rows:
            groups.setdefault(g if by else "all", []).append((v != v, 0.0 if v != v else v, i))
        seen = 0
        for r in got:
            mine = groups[r["g"] if by else "all"]
            v = (r["v"] != r["v"], 0.0 if r["v"] != r["v"] else r["v"])
            before, here = [m for m in mine if m[:2] < v], [m for m in mine if m[:2] == v]
            assert (r["n"], r["n_before"], r["n_total"], r["ids_before"]) == (len(here), len(before), len(mine), sum(m[2] for m in before))
            seen += r["n"]
        assert seen == len(rows)


def test_other_types_have_ranks(spark):
    df = spark.sql("SELECT id, date_add(date'1960-01-01', CAST(id AS INT)) AS d, CAST(id AS DECIMAL(9,2)) AS c, CAST(id - 5 AS INT) AS i FROM range(12)")
    for c in "dci":
        assert [r["n_before"] for r in ranks.value_ranks(df, [], c).orderBy(c).collect()] == list(range(12))


def test_few_rows_are_ranked_to_take_few(skewed):
    _, df = skewed
    full = {(r["g"], r["id"]): r["rn"] for r in ranks.hash_ranks(df, ["g"], 3, ["id"]).collect()}
    some = {(r["g"], r["id"]): r["rn"] for r in ranks.hash_ranks(df, ["g"], 3, ["id"], upto=5).collect()}
    assert some == {k: v for k, v in full.items() if v <= 5}

"""Steps that did work twice, sorted rows for a short list, or gave one task all rows of a class."""

import math

import pytest
from pyspark.sql import functions as F

from tallgene.functions import lists
from tallgene.operators import filters as fl
from tallgene.operators import metrics as mt
from tallgene.operators import samples as sm
from tallgene.operators import sequence as sq
from tallgene.operators import setops as so


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def plain_joins(spark):
    for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(k)


def test_rows_of_one_class_are_many_tasks(spark, plain_joins):
    names = spark.createDataFrame([("A", 0), ("B", 1)], "label string, label_id int")
    preds = spark.range(4000).select("id", F.when(F.col("id") < 9, -100).when(F.col("id") < 12, None).otherwise(0).alias("label_id"), F.lit(1).alias("predicted_id"))
    out = mt.label_frame(preds, names)
    assert set(out.columns) == {"predicted_id", "label_id", "id", "predicted", "label"}
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 2000
    assert {tuple(r) for r in out.groupBy("label", "predicted").count().collect()} == {(mt.SILENCED, "B", 9), (None, "B", 3), ("A", "B", 3988)}


def test_common_genes_of_all_parts(spark, plain_joins):
    def part(*genes):
        return spark.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, value int")

    parts = {"a": part("x", "x", "y", None), "b": part("x", "y", "z", None), "c": part("z", "x", None)}
    out = so.concat_inner(parts)
    assert sorted(map(tuple, out.collect())) == [("x", 0, "a"), ("x", 0, "b"), ("x", 1, "a"), ("x", 1, "c")]
    assert so.concat_inner({**parts, "d": part("q")}).count() == 0
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_bins_of_random_contacts_are_made_once(spark):
    chunks = spark.createDataFrame([(c, i, "ACGT" if i % 5 else "NNNN") for c in "ab" for i in range(12)], "chrom string, chunk long, seq string")
    sizes = spark.createDataFrame([("a", 48), ("b", 48)], "chrom string, len int")
    contacts = spark.createDataFrame([("a", 1, 2, 3.0)], "chrom string, bin1 long, bin2 long, oe double")
    out = sq.contact_random(chunks, contacts, sizes, 4, 3)
    assert "rlike" not in plan(out).lower()
    rows = out.collect()
    assert len(rows) == 2 * 4 * 3 and all(r["bin_i"] % 5 and r["bin_j"] % 5 and r["bin_i"] != r["bin_j"] for r in rows)


def test_items_are_made_once(spark):
    items = "array<struct<gene string, value double>>".replace("gene ", "gene:").replace("value ", "value:")
    s = spark.createDataFrame([("a", [("g", 1.0), ("h", 0.0), ("i", 0.0)]), ("b", []), ("c", None)], f"cell_id string, items {items}")
    out = sm.item_rows(sm.pad_random(s, 2))
    assert plan(out).count("md5(") == 1
    assert [(r["cell_id"], r["pos"], r["value"]) for r in out.orderBy("cell_id", "pos").collect()] == [("a", 0, 1.0), ("a", 1, 0.0)]


@pytest.mark.parametrize("piece", [2, 4096])
def test_dense_samples_are_the_dense_rows(spark, piece, monkeypatch):
    monkeypatch.setattr(lists, "PIECE", piece)
    expr = spark.createDataFrame([("a", "g1", 2.0), ("a", "g4", 1.0), ("b", "g2", None), (None, "g1", 5.0), ("z", "g1", 1.0)], "cell_id string, gene string, value double")
    cells = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "cell_id string")
    genes = spark.createDataFrame([(g,) for g in ("g1", "g2", "g3", "g4", "g5", "g2", None)], "gene string")
    out = fl.dense_samples(expr, cells, genes)
    want = sm.build_samples(fl.dense_rows(expr, cells, genes))
    key = lambda r: r["cell_id"] or ""
    assert sorted(out.collect(), key=key) == sorted(want.collect(), key=key) and out.count() == 4
    assert piece < 5 or "Generate explode(concat" not in plan(out)


def test_text_is_dealt_by_its_length(spark, monkeypatch):
    monkeypatch.setattr(sq, "HELD", 1)
    seqs = spark.createDataFrame([(c, "".join("ACGT"[(i * i + len(c)) % 4] for i in range(n))) for c, n in (("a", 95), ("bb", 40), ("ccc", 0))], "chrom string, seq string")
    tiles = sq.to_tiles(seqs, 10)
    cuts = spark.createDataFrame([("a", 3, 9), ("a", 8, 95), ("a", 10, 20), ("bb", 0, 40), ("bb", 39, 60), ("ccc", 0, 5), ("d", 0, 5)], "chrom string, start long, end long")
    out = sq.extract(tiles, cuts, 10, sq.tile_lengths(tiles))
    text = dict(map(tuple, seqs.collect()))
    got = {tuple(r) for r in out.collect()}
    assert got == {(c, a, b, text[c][a:b]) for c, a, b in map(tuple, cuts.collect()) if text.get(c, "")[a:b]}
    assert got == {tuple(r) for r in sq.extract(tiles, cuts, 10).collect()}
    assert out.rdd.getNumPartitions() == 14


def counted(first, low, high, u, ratio):
    p = c = first
    k = low + (c <= u)
    for i in range(low + 1, high + 1):
        p *= ratio(i)
        c += p
        k += c <= u
    return k


def test_draws_count_as_the_plain_rounds_do(spark):
    rows = [(float(n), 0.1 + 0.04 * (n % 10), ((n * 37) % 101) / 101) for n in range(1, 200)]
    df = spark.createDataFrame([*rows, (None, 0.3, 0.5)], "n double, p double, u double")
    out = df.select("*", sm.binomial(F.col("n"), F.col("p"), F.col("u")).alias("b"), sm.poisson(F.col("n"), F.col("u")).alias("k"))
    assert "aggregate(" not in plan(out)
    for r in out.where("n IS NOT NULL").collect():
        n, p, u = int(r["n"]), r["p"], r["u"]
        top = min(n, math.ceil(n * p + 9 * math.sqrt(n * p * (1 - p)) + 24))
        assert r["b"] == min(n, counted(math.exp(n * math.log1p(-p)), 0, top, u, lambda k: (n - k + 1) / k * p / (1 - p)))  # noqa: B023
        assert r["k"] == counted(math.exp(-n), 0, math.ceil(n + 9 * math.sqrt(n) + 24), u, lambda k: n / k)  # noqa: B023
    assert out.where("n IS NULL").first()["k"] is None

"""What grew too fast with the input: each test failed or took a form that grows before the change it names."""

import numpy as np
import pytest

from tallgene.functions import blocks, metric
from tallgene.operators import embed
from tallgene.operators import sequence as sq
from tallgene.plans.catalogue import QUERIES
from tallgene.sources import io


def vectors(spark, ids, x, labels=None):
    rows = [(int(i), None if labels is None else labels[n], x[n].tolist()) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "vec_id long, label string, vec array<double>")


def test_neighbours_of_one_ball_meet_in_yards(spark, monkeypatch):
    """emb_knn_graph: where every point reaches every cell, its vector was copied once for each cell."""
    asked, plain = [], metric.visits
    monkeypatch.setattr(metric, "visits", lambda cells, first, k, **how: asked.append(how) or plain(cells, first, k, **how))
    monkeypatch.setattr(metric, "YARD_ROWS", 64)
    monkeypatch.setattr(metric, "TILE", (7, 11))
    monkeypatch.setattr(metric, "PENDING", 40)
    rng = np.random.default_rng(6)
    x, ids = np.round(rng.normal(size=(500, 8))), rng.permutation(3000)[:500]  # whole numbers, so many distances are the same
    got = {(r["vec_id"], r["rank"]): (r["neighbor"], round(r["distance"], 6)) for r in embed.knn(vectors(spark, ids, x), 6, block=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {}
    for a in range(500):
        near = sorted((round(d[a, b], 9), int(ids[b])) for b in range(500) if b != a)[:6]
        want |= {(int(ids[a]), r + 1): (i, round(v, 6)) for r, (v, i) in enumerate(near)}
    assert got == want
    assert asked == [{"counted": True}]


def test_yards_meet_once(spark):
    """emb_silhouette: every distance was worked out in both directions."""
    rows = spark.range(200).toDF("id")
    met = blocks.block_meetings(rows, "id", 8, lambda a, b: a.head(1).assign(n=len(a) * len(b))[["id", "n"]], "id long, n long", 16, mutual=True)
    assert 200 * 200 / 2 < sum(r["n"] for r in met.collect()) < 0.75 * 200 * 200


@pytest.mark.parametrize("within", [False, True])
def test_silhouettes_against_all_distances(spark, monkeypatch, within):
    monkeypatch.setattr(embed, "TILE", (5, 9))
    monkeypatch.setattr(embed, "YARD_ROWS", 16)
    rng = np.random.default_rng(9)
    n = 150
    x = rng.normal(size=(n, 3)) + rng.integers(0, 3, n)[:, None]
    labels = [None if i % 31 == 5 else f"l{rng.integers(0, 4)}" for i in range(n)]
    labels[17] = "alone"
    part = [None if i % 29 == 3 else f"p{i % 3}" for i in range(n)]
    ids = np.r_[np.arange(n - 4), [3, 3, 8, 20]]  # some rows share an id, and are at distance 0
    rows = spark.createDataFrame([(int(ids[i]), labels[i], part[i], x[i].tolist()) for i in range(n)], "vec_id long, label string, part string, vec array<double>")
    got = {(r["vec_id"], r["label"]): r["silhouette"] for r in embed.silhouette_samples(rows, "label", "part" if within else None, block=8).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d[ids[:, None] == ids[None]] = 0
    sums = {}
    for i in range(n):
        for j in range(n):
            if labels[j] is not None and (not within or part[i] == part[j]):
                s = sums.setdefault((int(ids[i]), labels[i]), {}).setdefault(labels[j], [0.0, 0])
                s[0], s[1] = s[0] + d[i, j], s[1] + 1
    assert got.keys() == sums.keys()
    for key, per in sums.items():
        own, others = per.get(key[1]), [s / m for label, (s, m) in per.items() if label != key[1] and key[1] is not None]
        if not others:
            assert got[key] is None
        elif own and own[1] == 1:
            assert got[key] == 0
        elif own:
            a, b = own[0] / (own[1] - 1), min(others)
            assert got[key] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_result_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    """src_pred_csv wrote plain text, eight times the input, and exchanged arrays."""
    monkeypatch.setattr(io, "LINES", 2)
    rows = spark.createDataFrame([(f"c{i}", [i / 3, -i / 7], i % 2, [float(i), i / 9]) for i in range(5)], "cell_id string, embedding array<double>, predicted_id int, logits array<double>").coalesce(1)
    tables = io.result_tables(rows, spark.createDataFrame([(0, "x"), (1, "y")], "label_id int, label string"), ["x", "y"])
    tables["logits"] = tables["logits"].where("cell_id <> 'c3'")
    io.write_results(tables, str(tmp_path / "out"))
    files = sorted(f.name for f in (tmp_path / "out" / "probabilities.csv").glob("part-*"))
    assert len(files) == 3 and all(f.endswith(".csv.gz") for f in files)
    out = io.read_predictions(spark, str(tmp_path / "out"), 2, ["x", "y"])
    got = {r["cell_id"]: (r["embedding"], r["prediction"], r["logits"]) for r in out.collect()}
    assert got == {f"c{i}": ([i / 3, -i / 7], "xy"[i % 2], None if i == 3 else [float(i), i / 9]) for i in range(5)}
    assert out.schema["logits"].dataType.simpleString() == "array<double>"
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "array(" not in below


def test_labels_of_inner_nodes_list_the_leaves_below(spark):
    """mat_label_ontology asked for leaves alone, so the closure of the ontology changed none of its rows."""
    class Tables:
        part = spark.createDataFrame([(k, f"n{k}", "SMALL", f"Brand#{k % 2 + 1}", 5) for k in range(6)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int")
        lineitem = spark.createDataFrame([(1, 1, 3, 25, "N"), (2, 1, 3, 25, "R"), (64, 1, 3, 1, "A"), (65, 1, 3, 25, "A")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string")

    got = {r["l_orderkey"]: (r["leaf_ids"], r["has_leaves"]) for r in QUERIES["mat_label_ontology"](Tables).collect()}
    assert got == {1: ("0,2,4", 1), 2: ("", 0), 64: ("1,3,5", 1), 65: ("3", 1)}


def test_sites_of_a_stretch_are_made_at_once(spark):
    """var_sample_pairs_replaced, var_sample_sites: each letter of an allele was a row that was sorted twice."""
    rows = [("c", 1022, "ACG", [("ACG", 0.5), ("A", 0.25), ("ACGTT", 0.25)]), ("c", 1023, "C", [("C", 1.0), ("é", None)]), ("c", 5, "", [("", 1.0)]), ("c", 9, "G", []), ("d", 7, "T", [(None, 0.5), ("G", 0.5)]), ("d", None, "T", [("T", 1.0)])]
    v = spark.createDataFrame(rows, "chrom string, pos long, ref string, alleles array<struct<allele string, prob double>>")
    got = {(r["chrom"], r["pos"], r["symbol"]): (r["prob"], r["is_variant"]) for r in sq.variant_sites(v).collect()}
    assert got == {
        ("c", 1022, "A"): (1.0, False), ("c", 1023, "C"): (1.75 / 2, True), ("c", 1023, "DEL"): (0.25 / 2, True), ("c", 1023, "é"): (None, True),
        ("c", 1024, "G"): (0.5, True), ("c", 1024, "GI"): (0.25, True), ("c", 1024, "DEL"): (0.25, True),
        ("c", 5, "DEL"): (1.0, False), ("c", 4, ""): (1.0, False), ("d", 7, "DEL"): (0.5, True), ("d", 7, "G"): (0.5, True), ("d", None, "T"): (1.0, False)}
    whole = sq.variant_sites(v, binned=True)
    assert {(r["chrom"], r["pos"], x["symbol"]): (x["prob"], r["is_variant"]) for r in whole.collect() for x in r["a"]} == got
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Window" not in plan and plan.count("_whole_sites_of") == 1

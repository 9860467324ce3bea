"""Exact and approximate nearest neighbours against brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgene.llm import cover_tree, nndescent, queries

DDL = "vec_id long, embedding array<float>, score string"


def _clustered(n=900, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    v = centers[rng.integers(0, 6, n)] + 0.7 * rng.normal(size=(n, dim))
    return (v * rng.uniform(0.5, 2, (n, 1))).astype(np.float32)


def _frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in vectors], DDL)


BAD = [(100_000, None), (100_020, [0.0] * 16), (100_040, [math.nan] + [1.0] * 15), (100_060, [math.inf] * 16), (100_080, [None] + [1.0] * 15), (100_100, [])]


def test_dual_tree_is_exact_with_ties():
    rng = np.random.default_rng(0)
    data = rng.integers(-3, 4, (700, 5)).astype(float)  # many equal products
    ids = rng.permutation(700)
    q = np.arange(0, 700, 9)
    scores, found = cover_tree.dual_search(data[q], ids[q], np.full(len(q), -np.inf), data, ids, 10)
    all_scores = data[q] @ data.T
    all_scores[np.arange(len(q)), q] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, all_scores.shape), -all_scores), axis=1)[:, :10]
    assert (found == ids[order]).all() and (scores == np.take_along_axis(all_scores, order, 1)).all()


def test_cover_radii_hold_all_points():
    tree = cover_tree.CoverTree(_clustered())
    nodes, seen = [tree.root], 0
    while nodes:
        node = nodes.pop()
        own = tree.vectors[tree.order[node.start : node.stop]]
        assert np.sqrt(((own - node.center) ** 2).sum(1)).max() <= node.radius * (1 + 1e-6) + 1e-9
        nodes += node.children
        seen += not node.children and node.stop - node.start
    assert seen == 900


@pytest.mark.parametrize("block", [4096, 97])
def test_exact_top_k(spark, block):
    v = [*enumerate(_clustered(400)), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (500, [1.0, -1.0]), *BAD]
    v += [(1000 + i, v[0][1]) for i in range(40)]
    got = cover_tree.exact_top_k(_frame(spark, v), F.col("id") % 100 == 0, k=10, block=block, query_block=3)
    good = {i: [math.floor(1024 * float(x)) for x in vec] for i, vec in v if vec is not None and all(x is not None and math.isfinite(x) for x in vec)}
    want = []
    for q in (i for i in good if i % 100 == 0):
        near = sorted((-sum(a * b for a, b in zip(good[q], good[i], strict=True)), i) for i in good if i != q and len(good[i]) == len(good[q]))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert cover_tree.exact_top_k(_frame(spark, v).limit(0), F.col("id") % 100 == 0).count() == 0


def test_nearest_recall_scores_and_edges(spark):
    v = [*enumerate(_clustered()), (5000, [1.0, 2.0]), *BAD]
    v += [(2000 + i, v[20][1]) for i in range(60)]  # copies of a query
    rows = nndescent.nearest(_frame(spark, v), F.col("id") % 20 == 0, k=20, rounds=4).collect()
    good = {i: np.array(vec, float) for i, vec in v if i < 3000}
    ids, x = np.array(list(good)), np.stack(list(good.values()))
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(r)
    queries = [i for i in good if i % 20 == 0]
    assert sorted(found) == queries
    recall = []
    for q in queries:
        s = x @ good[q]
        order = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        mine = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - good[r["vec_id"]] @ good[q]) < 1e-9 for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        recall.append(len({r["vec_id"] for r in mine} & set(order)) / 20)
    assert np.mean(recall) >= 0.95


def test_nearest_of_few_rows(spark):
    few = _frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (20, [0.0, 3.0])])
    got = [tuple(r)[:3] for r in nndescent.nearest(few, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 20), (0, 3, 2), (20, 1, 1), (20, 2, 0), (20, 3, 2)]
    assert nndescent.nearest(few.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("block", [4096, 20])
def test_exact_top_k_repeated_ids_as_twin(spark, tmp_path, block):
    rng = np.random.default_rng(5)
    ids = [*range(90), *range(0, 90, 3), 7, 7]
    v = rng.normal(size=(len(ids), 4)).astype(np.float32)
    v[-1] = v[-2]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")
    rows.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op8_exact_top_k"].replace("% 100", "% 30")).fetchall()
    got = cover_tree.exact_top_k(rows, F.col("id") % 30 == 0, k=10, block=block, query_block=3).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scores_beyond_float64_are_exact(spark):
    rng = np.random.default_rng(8)
    for size in (1 << 16, 1 << 26, 1 << 34):  # products about 2**36, 2**56 and 2**72
        rows = [(i, [float(v) for v in rng.integers(-size, size, 4)]) for i in range(300)]
        rows += [(400 + j, [float(size - 1), float(size - 3), 0.0, float(j)]) for j in range(5)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in cover_tree.exact_top_k(df, F.col("id") % 100 == 0, k=10, scale=1, block=64).collect()}
        most = 2**63 - 1
        for q, v in rows:
            if q % 100 == 0:
                scored = sorted((-max(-most, min(most, sum(int(a) * int(b) for a, b in zip(v, w, strict=True)))), i) for i, w in rows if i != q)
                assert [got[q, r + 1] for r in range(10)] == [(i, -s) for s, i in scored[:10]]


@pytest.mark.parametrize("norms", ["one long", "log-normal"])
def test_recall_with_uneven_norms(spark, norms):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2500, 24))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    if norms == "one long":
        x[7] *= 10_000
    else:
        x *= rng.lognormal(0, 1, (len(x), 1))
    x = x.astype(np.float32).astype(float)
    rows = nndescent.nearest(_frame(spark, enumerate(x)), F.col("id") % 50 == 0, k=20, rounds=4).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in range(0, len(x), 50):
        scores = x @ x[q]
        scores[q] = -np.inf
        recall.append(len(found[q] & set(np.argsort(-scores)[:20])) / 20)
    assert np.mean(recall) >= 0.9

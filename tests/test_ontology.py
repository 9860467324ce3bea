"""Closure and leaves of ontologies against plain walks."""

import random

import pytest

from tallgene.operators import examples as ex
from tallgene.operators import ontology as on


def walked(nodes, edges):
    """(ancestor, node) -> steps of the shortest path."""
    below, out = {}, {(n, n): 0 for n in nodes}
    for a, b in edges:
        below.setdefault(a, []).append(b)
        out.setdefault((a, b), 1)
    for top in {*nodes, *below}:
        front, dist, seen = [top], 0, {top} if top in nodes else set()
        while front:
            dist += 1
            front = [b for b in {b for a in front for b in below.get(a, [])} if b not in seen]
            seen.update(front)
            for b in front:
                out[top, b] = min(dist, out.get((top, b), dist))
    return out


def tables(spark, nodes, edges):
    return spark.createDataFrame([(n, n) for n in nodes], "id string, name string"), spark.createDataFrame(edges, "parent string, child string")


@pytest.mark.parametrize("below", [1, 3, 1 << 16])
def test_closure_of_dags_and_cycles(spark, below, monkeypatch):
    monkeypatch.setattr(on, "BELOW", below)
    rng = random.Random(below)
    nodes = [f"n{i}" for i in range(24)]
    chain = [(f"n{i}", f"n{i + 1}") for i in range(13)]
    edges = [*{*chain, *((f"n{rng.randrange(24)}", f"n{rng.randrange(24)}") for _ in range(12)), ("n3", "n0"), ("out", "n5")}]
    got = [((r["ancestor"], r["node"]), r["dist"]) for r in on.closure(*tables(spark, nodes, edges)).collect()]
    want = walked(nodes, edges)
    assert len(got) == len(dict(got)) and dict(got) == want


def test_a_round_joins_no_known_pairs(spark, monkeypatch):
    """Pairs were joined with all others again in every round: a star below a root was read through the root each time."""
    met, plain = [], on._longer
    monkeypatch.setattr(on, "_longer", lambda front, tails: met.append((front.count(), tails.count())) or plain(front, tails))
    nodes = ["root", "mid", *(f"p{i}" for i in range(50))]
    edges = [("root", "mid"), *(("mid", f"p{i}") for i in range(50))]
    assert on.closure(*tables(spark, nodes, edges)).count() == 52 + 51 + 50
    assert met == [(51, 51), (50, 101)]


def test_leaves_are_numbered_over_ranges(spark):
    ids = [f"P{i}" for i in range(3000)]
    nodes, edges = tables(spark, [*ids, "a", "b"], [("a", "b"), ("b", "P7")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # ranges are not merged, so there are several
    try:
        got = on.leaves(nodes, edges)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert {r["id"]: r["label_id"] for r in got.collect()} == {x: i for i, x in enumerate(sorted(ids))}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "[_range" in plan and dict(got.dtypes)["label_id"] == "int"


def test_leaf_lists_are_made_only_below_labels_that_occur(spark):
    nodes, edges = tables(spark, ["root", "a", "b", "c"], [("root", "a"), ("root", "b"), ("a", "c")])
    obs = spark.createDataFrame([(1, "a"), (2, "none"), (3, None), (4, "a")], "cell int, lab string")
    out = ex.label_ontology(obs, on.leaves(nodes, edges), on.closure(nodes, edges), "lab")
    assert {r["cell"]: r["leaf_ids"] for r in out.collect()} == {1: [1], 2: [], 3: [], 4: [1]}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()

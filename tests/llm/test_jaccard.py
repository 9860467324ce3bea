"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from tallgene.llm import graph, jaccard


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """doc_id -> (set size, component) with rows of one doc_id as one node."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, s in sets:
        own = [find(j) for j, b in sets if j is not None and s and b == s]
        out.append((i, len(s), find(i) if i is not None else min(own, default=None)))
    return sorted(out, key=str)


def near_copies(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows, i = [], 0
    for family in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 25, 60, 160]))]
        for _ in range(rng.choice([1, 2, 9, 25])):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words) + (" " + shared if family % 3 == 0 else "")
            rows.append((i, text.upper() if rng.random() < 0.2 else text))
            i += 1
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "a\0b c"), (1006, "a\x01b c"), (1007, "é É"), (1008, "é é"), (None, "one"), (None, "unlike all"), (1003, "one")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"REGION": 6, "PIVOTS": 3}, {"CELL": 300, "SALTS": 3, "HOT": 20, "LOCAL": 1}])
def test_join_matches_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, prefix string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_crowded_regions_are_compared_in_blocks(spark, monkeypatch):
    """Unlike documents of one region were joined pivot by pivot, in rounds that grow with the region."""
    for name, value in {"REGION": 20, "BLOCK": 8, "LOCAL": 1 << 20}.items():
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "join_large", lambda *a: pytest.fail("rounds over a region of unlike documents"))
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 45, 60, 200]))) + " " + shared) for i in range(90)]
    rows += [(100 + i, rows[3 * i][1] + " more") for i in range(20)] + [(200, rows[3][1]), (3, rows[8][1])]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(docs).count() == 0


def _family(rng, n, keep):
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    return [np.unique(np.r_[base[rng.random(200) < keep], rng.integers(0, 2**63, rng.integers(1, 30)).astype(np.uint64)]) for _ in range(n)]


def test_cells_keep_every_component(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rng = np.random.default_rng(1)
    for keep in (0.5, 0.8, 0.93, 0.99):
        sets = [s for _ in range(5) for s in _family(rng, 30, keep)]
        cells = jaccard.Cells(sets)
        cells.join(np.arange(len(sets)))
        truth = jaccard.Cells(sets)
        for i in range(len(sets) - 1):
            truth.meet(i, np.arange(i + 1, len(sets)))
        assert [cells.find(i) for i in range(len(sets))] == [truth.find(i) for i in range(len(sets))]


def test_sketches_never_part_a_link():
    rng = np.random.default_rng(2)
    sets = _family(rng, 60, 0.93) + [np.unique(np.r_[s, s[:20] + np.uint64(1)]) for s in _family(rng, 20, 0.99)] + [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 5, 300, 1000)]
    sketches = [np.minimum(np.bincount((s & np.uint64(jaccard.classes(len(s)) - 1)).astype(int), minlength=jaccard.classes(len(s))), 255).astype(np.uint8).tobytes() for s in sets]
    may = jaccard.may_link(np.array([len(s) for s in sets]), sketches)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert may[i, j] and may[j, i]


def test_components_and_key_filter(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7), (300, 200), (200, 300)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    keys = graph.KeyFilter.of(spark.createDataFrame([(5,), (-9,), (None,)], "k long"), "k")
    assert keys.maybe(np.array([5, -9])).all() and keys.maybe(np.arange(1000, 2000)).sum() < 5


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a.replace("a39", "z")
    rows = [(0, a, "x"), (1, near, "x"), (1, b, "x"), (2, c, "q"), (2, c, "p"), (None, c, "x"), (None, "only here", "x"), (None, "only here", "x"), (7, None, "x"), (7, None, "x"), (8, " \t", "x"), (-5, b + " more", "key")]
    got = jaccard.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    want = [(0, a, "x"), (2, c, "p"), (-5, b + " more", "key"), (None, "only here", "x"), (7, None, "x"), (7, None, "x"), (8, " \t", "x")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) or sorted(map(str, map(tuple, got))) == sorted(map(str, [(2, c, "q"), *(w for w in want if w[0] != 2)]))
    assert jaccard.without_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0

"""Part codes: trees against all distances, codes and codebooks against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from tallgene.llm import part_codes
from tallgene.llm.anchors import AnchorTree


def clustered(rng, n, w):
    return (rng.integers(-300, 300, (12, w))[rng.integers(0, 12, n)] + rng.integers(-9, 9, (n, w))).astype(float)


@pytest.mark.parametrize("n,w", [(1, 4), (24, 1), (25, 2), (700, 4), (2048, 8)])
def test_owners_are_the_nearest(n, w):
    rng = np.random.default_rng(n)
    points = clustered(rng, n, w)
    points[n // 2 :] = points[n // 2]  # one very common point
    tree = AnchorTree.build(points)
    assert sorted(tree.order.tolist()) == list(range(n)) and (tree.points == points[tree.order]).all()
    for entries in (points[rng.integers(0, n, 64)], rng.integers(-300, 300, (5, w)), np.zeros((3, w))):
        got, counts, sums = np.full(n, -1), np.zeros(len(entries)), np.zeros((len(entries), w))
        calls = []

        def settle(entry, low, high, total):
            calls.append(len(entry))
            for e, a, b, s in zip(entry, low, high, total, strict=True):
                assert (got[tree.order[a:b]] == -1).all()
                got[tree.order[a:b]] = e
                counts[e] += b - a
                sums[e] += s

        tree.owners(np.asarray(entries), settle)
        far = ((points[:, None] - np.asarray(entries)[None]) ** 2).sum(2)
        assert got.tolist() == far.argmin(1).tolist()
        assert all((sums[e] == points[got == e].sum(0)).all() for e in range(len(entries)))


def test_balls_are_owned_whole():
    rng = np.random.default_rng(1)
    points = np.repeat(np.arange(12), 200)[:, None] * 1000.0 + rng.integers(0, 30, (2400, 1))
    tree, calls = AnchorTree.build(points), []
    tree.owners(np.arange(12)[:, None] * 1000.0, lambda e, a, b, s: calls.extend((b - a).tolist()))
    assert sum(calls) == 2400 and len(calls) < 100


def plain(rows, parts, entries, rounds, scale):
    """(vec_id, code, error, label) and the digest, by the definition."""
    ok = [(i, [math.floor(scale * float(c)) for c in v], g) for i, v, g in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(ok[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in ok[:entries]] for p in range(parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((d2(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        after = [[list(e) for e in b] for b in books]
        for p in range(parts):
            owned = {}
            for _, v, _ in ok:
                owned.setdefault(near(v, p)[1], []).append(cut(v, p))
            for k, vs in owned.items():
                after[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
        books = after
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, g in ok:
        found = [near(v, p) for p in range(parts)]
        out.append((i, bytes(k for _, k in found).hex(), sum(d for d, _ in found), g))
    return out, sha


def check(spark, rows, schema="vec_id long, embedding array<double>, label int, error string", block=64, **options):
    options = {"parts": 4, "entries": 8, "rounds": 2, "scale": 256} | options
    df = spark.createDataFrame([(*r, "extra") for r in rows], schema).repartition(3)
    got = sorted(map(str, (tuple(r) for r in part_codes.compress(df, **options).collect())))
    coded, sha = plain(rows, **options)
    sums = {}
    for _, _, e, g in coded:
        sums[g] = sums.get(g, 0) + e
    assert got == sorted(str((i, c, e, sums[g], sha)) for i, c, e, g in coded)


def test_codes_match_definition(spark, monkeypatch):
    monkeypatch.setattr(part_codes, "BLOCK", 64)
    rng = np.random.default_rng(4)
    rows = [(int(i), (clustered(rng, 1, 8)[0] / 100 + rng.random(8)).tolist(), int(i) % 3 or None) for i in rng.permutation(300)]
    rows += [rows[5]] * 40 + [(None, rows[7][1], 1), (3, rows[9][1], 2)]
    bad = [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [1.0] * 7 + [math.nan], None), (903, [math.inf] * 8, 2)]
    check(spark, rows + bad)
    check(spark, rows[:5], entries=8)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-(1 << 19), 1 << 19, 4) * (1.0 if i % 2 else 32.0)).tolist(), 0) for i in range(60)]
    check(spark, rows, scale=1)
    tiny = [(i, [float(i % 7)] * 4, None) for i in range(30)]
    check(spark, tiny, scale=1, parts=4, rounds=0)


def test_other_lengths_keep_null_codes(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 0), (3, [1.0, 2.0, 3.0, 4.0], 0), (4, [1.0], 1), (5, [], None)]
    got = {r["vec_id"]: r for r in part_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), parts=2).collect()}
    assert got.keys() == {1, 2, 3, 4, 5}
    assert got[1]["code"] == "0000" and got[2]["code"] == "0101" and got[1]["error"] == 0
    assert all(got[i]["code"] is None and got[i]["error"] is None for i in (3, 4, 5)) and got[4]["label_error"] is None
    assert part_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0

"""The bucketed store against a dictionary."""

import os
import random

import pytest

from tallgene.streaming import jobs

SCHEMA = "gene_symbol string, biosample_name string, a double, b int, t int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def apply(state, rows, order):
    for g, s, a, b, t in sorted(rows, key=lambda r: r[4] if order else 0):
        old = state.get((g, s), (None, None))
        state[g, s] = (old[0] if a is None else a, old[1] if b is None else b)


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_updates_one_after_the_other(spark, tmp_path):
    rng, state = random.Random(2), {}
    store = jobs.Store(spark, str(tmp_path), buckets=4, compact_after=2, order="t")
    for number in range(5):
        rows = [(rng.choice([None, *"pqrstu"]), rng.choice("xy"), rng.choice([None, rng.random()]), rng.choice([None, rng.randint(0, 99)]), 100 * number + i) for i in range(25)]
        store.apply(frame(spark, rows), number)
        before = files(tmp_path)
        apply(state, rows, True)
        got = {(r["gene_symbol"], r["biosample_name"]): (r["a"], r["b"]) for r in store.read().collect()}
        assert got == state
        store.apply(frame(spark, rows), number)  # a retry
        assert {(r["gene_symbol"], r["biosample_name"]): (r["a"], r["b"]) for r in store.read().collect()} == state
        assert len(files(tmp_path)) == len(before)
    assert {(r["gene_symbol"], r["biosample_name"]) for r in store.read(0).collect()} <= state.keys()


def test_a_small_update_rewrites_one_bucket(spark, tmp_path):
    store = jobs.Store(spark, str(tmp_path), buckets=8, compact_after=2)
    store.apply(frame(spark, [(f"g{i}", "x", float(i), i, 0) for i in range(200)]), 0)
    assert len({p.split("bucket=")[1].split("/")[0] for p in files(f"{tmp_path}/delta/batch=0")}) == 8
    store.apply(frame(spark, [("g7", "x", None, -1, 1)]), 1)
    assert len(files(f"{tmp_path}/delta/batch=1")) == 1 and len(files(f"{tmp_path}/base/batch=1")) == 1
    row = store.read().where("gene_symbol = 'g7'").first()
    assert (row["a"], row["b"]) == (7.0, -1) and store.read().count() == 200


def test_empty_updates_and_new_columns(spark, tmp_path):
    store = jobs.Store(spark, str(tmp_path), keys=["k"], buckets=2)
    store.apply(spark.createDataFrame([], "k string, a int"), 0)
    with pytest.raises(ValueError, match="no update"):
        store.read()
    store.apply(spark.createDataFrame([("p", 1)], "k string, a int"), 1)
    store.apply(spark.createDataFrame([("p", 2.0), ("q", 3.0)], "k string, c double"), 2)
    assert {r["k"]: (r["a"], r["c"]) for r in store.read().collect()} == {"p": (1, 2.0), "q": (None, 3.0)}


def test_batch_form(spark):
    old = spark.createDataFrame([("p", "x", 1.0), (None, "x", 2.0)], "gene_symbol string, biosample_name string, a double")
    new = spark.createDataFrame([("p", "x", None, 1), ("p", "x", 5.0, None), (None, "x", 7.0, 2)], "gene_symbol string, biosample_name string, a double, b int")
    assert {r["gene_symbol"]: (r["a"], r["b"]) for r in jobs.upsert(old, new).collect()} == {"p": (5.0, 1), None: (7.0, 2)}

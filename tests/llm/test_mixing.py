"""Source mixing against its SQL twin and by its budgets."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallgene.llm import mixing


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def _rows():
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), "en", rng.choice(["a", "b", "c", "é", None, ""]), 1) for i in range(300)]
    rows += [(7, rows[7][1], "en", rows[7][3], 1), (None, "x y z", "de", "a", 1), (None, None, None, None, None), (900, "t " * 500, "en", "tiny", 1), (901, " ", "en", "void", 1)]
    return rows + [(1000 + i, "hot source words", "en", "hot", 1) for i in range(200)]


def test_mix_matches_sql(spark):
    rows = _rows()
    docs = _docs(spark, rows)
    con = duckdb.connect()
    frame = docs.toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    con.execute("CREATE TABLE d AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents")
    want = con.execute(mixing.MIX_SQL.replace("FROM documents", "FROM d")).fetchall()
    names = [c[0] for c in con.description]
    got = [tuple(r[n] for n in names) for r in mixing.mix(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_budgets_caps_and_reruns(spark):
    docs = _docs(spark, _rows())
    plan = mixing.mix(docs, keep=("doc_id", "source")).collect()
    sums = {}
    for r in plan:
        s = sums.setdefault(r["source"], [0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(taken == int(target) and target <= 3 * size for taken, target, size in sums.values())
    assert abs(sum(t for _, t, _ in sums.values()) - sum(s for *_, s in sums.values())) < 1e-6
    again = mixing.mix(docs.repartition(7), keep=("doc_id", "source")).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def test_levels_fill_capped_sources(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a takes 30 and null 15 at most; b and c share the rest two to one
    assert got["a"] == 30 and got[None] == 15
    assert got["b"] == pytest.approx(1970 * 2 / 3) and got["c"] == pytest.approx(1970 / 3)


def test_mixed_rows(spark):
    docs = _docs(spark, _rows())
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    taken = {(r["doc_id"], r["source"]): 0 for r in docs.collect()}
    for r in rows.select("doc_id", "source", mixing.n_words(F.col("text")).alias("n")).collect():
        taken[r["doc_id"], r["source"]] += r["n"]
    plan = {}
    for r in mixing.mix(docs, keep=("doc_id", "source")).collect():
        plan[r["doc_id"], r["source"]] = plan.get((r["doc_id"], r["source"]), 0) + r["taken"]
    assert taken == plan
    assert mixing.mixed_rows(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_native_plan(spark):
    plan = mixing.mixed_rows(_docs(spark, _rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

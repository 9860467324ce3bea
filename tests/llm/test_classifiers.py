"""Language and toxicity: held-out accuracy on the given tables, and the edges."""

import os

import pytest
from pyspark.sql import functions as F

from tallgene.llm import language, queries, toxicity

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
EDGES = [(1, None), (2, ""), (3, "123 !?"), (4, "the cat and the dog"), (4, "the cat and the dog"), (5, "漢字"), (6, "word " * 50_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_held_out(spark, docs):
    found = queries.op6_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.98
    assert found.count() == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, docs):
    edges = spark.createDataFrame([(*e, "en", 0.5) for e in EDGES], "doc_id long, text string, lang string, score double")
    model = language.fit(docs.limit(200).withColumn("lang", F.when(F.col("lang") == "en", None).otherwise(F.col("lang"))), per_language=20)
    assert "en" not in model.languages
    got = language.predict(edges, model).collect()
    assert len(got) == len(EDGES)
    assert all((r["lang_pred"], r["score"]) == ("und", 0) for r in got if r["doc_id"] < 4) and all(r["lang_pred"] in model.languages for r in got if r["doc_id"] > 3)
    assert language.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language.predict(edges, None).collect()} == {"und"}
    assert language.predict(edges.limit(0), model).count() == 0


def test_kernel_is_normalised():
    k = language.presence(["abc abc", "abc", "", "xyz"])
    products = k @ k.T
    assert abs(products[0, 0] - 1) < 1e-5 and products[2].max() == 0 and products[0, 1] > products[0, 3]


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = queries.op7_toxicity(spark, DATA).join(labels, "doc_id").collect()
    for part in (True, False):
        own = [r for r in rows if r["held_out"] == part]
        assert sum(r["predicted"] == r["toxic"] for r in own) / len(own) >= 0.93
        clean = [r for r in own if r["toxic"] == 0]
        assert sum(r["predicted"] for r in clean) / len(clean) <= 0.02
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edges(spark, docs):
    edges = spark.createDataFrame([(*e, 3, 0.5) for e in EDGES], "doc_id long, text string, predicted int, score double")
    none = spark.createDataFrame([(1, 2, None), (2, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none)
    got = toxicity.score(edges, model).collect()
    assert len(got) == len(EDGES) and all(r["predicted"] == 0 for r in got)
    assert toxicity.score(edges.limit(0), model).count() == 0


def test_toxicity_learns_words_and_beginnings():
    texts = [f"the good word {i} and more of it" + (" vile thing" if i % 3 == 0 else "") for i in range(300)]
    labels = toxicity.np.array([int(i % 3 == 0) for i in range(300)])
    model = toxicity.train(texts, labels)
    toxicity.calibrate(model, texts, labels)
    z, group = toxicity.raw_scores(model, ["some other vile text of the day", "some other fine text of the day"])
    cut = toxicity.np.log(model.threshold / (1 - model.threshold))[group]
    assert z[0] > cut[0] and z[1] < cut[1]


def test_toxicity_thresholds_cover_all_labels(spark):
    rows = [(i, f"the {'fine' if i % 100 < 75 else 'odd' if i % 100 < 95 else 'vile'} word {i % 37} of it", int(i % 100 >= 95 or (i % 100 >= 75 and i // 100 % 10 == 0))) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"), per_label=40)
    got = toxicity.score(table, model, keep=("text", "toxic")).collect()
    caught = sum(r["predicted"] for r in got if r["toxic"])
    wrong = sum(r["predicted"] for r in got if not r["toxic"])
    assert caught >= 100 and wrong <= 10
    # Thresholds follow the counts of all labels, whatever the size of the sample.
    best = max(2 * c / (c + w + 140) for c, w in ((100, 0), (140, 360)))
    assert 2 * caught / (caught + wrong + 140) >= best - 0.05

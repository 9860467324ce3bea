"""Documents to token ids in five stages; each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgene.functions.lineage import scratch_path
from tallgene.llm import jaccard, lexicon, mixing, pii, queries, toxicity
from tallgene.llm.batches import short_batches
from tallgene.llm.graph import kept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fit on the labelled ones outside fold 0 of 5, does not reject."""
    short_batches(spark)
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=tuple(docs.columns)).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the shingle join, see ``jaccard.without_near_copies``."""
    short_batches(spark)
    return jaccard.without_near_copies(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; ``n_chars`` follows the text."""
    short_batches(spark)
    replaced = pii.replace_all(docs)
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    short_batches(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, their number and digests of ids and of the text they decode to. Ids are written between encoding and decoding, as a
    task of both would hold two Python workers, and an executor keeps as many as it has had at once."""
    short_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = kept(lexicon.encode(docs, path, lexicon.build_lexicon(docs, path), keep=("doc_id", "source")), "encoded")
    return queries.digests(lexicon.decode(encoded, path, keep=("doc_id", "source", "ids")), "doc_id", "source", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Only the mixing is expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

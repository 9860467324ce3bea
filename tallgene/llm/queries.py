"""Registered queries of this package and, where SQL can say it, their twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgene.llm import cover_tree, jaccard, language, lexicon, mixing, nndescent, packing, part_codes, pii, token_counts, toxicity, variants, warc
from tallgene.llm.batches import short_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the merged index; a page's capture time is made from its id."""
    pages = table(spark, sf_dir, "pages").withColumn("ts", F.timestamp_seconds(F.lit(1_500_000_000) + F.col("page_id")))
    records = warc.read_archives(warc.archive(pages, min_bytes=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM h
"""


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents; tested against brute force."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document; tested against the tokenizers library."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def digests(decoded: DataFrame, *keep: str) -> DataFrame:
    """Digest columns of ``ids`` and ``decoded``."""
    return decoded.select(
        *keep, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests; tested against the tokenizers library."""
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    encoded = lexicon.encode(docs, path, lexicon.build_lexicon(docs, path))
    return digests(lexicon.decode(encoded, path, keep=("doc_id", "ids")), "doc_id")


@query
def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 20 largest inner products of every twentieth vector; recall is tested against brute force."""
    return nndescent.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def crc_mod(parts: int):
    """crc32 of doc_id as text, modulo ``parts``: the fold of a document."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document; learned outside fold 2 of 4, tested by held-out accuracy."""
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs.where(F.coalesce(crc_mod(4), F.lit(0)) != 2)))
    return found.select("doc_id", F.coalesce(crc_mod(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fit on labelled documents outside fold 0 of 5."""
    return toxicity.fit(docs, labels.where(crc_mod(5) != 0))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document; tested by held-out accuracy."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every hundredth vector."""
    return cover_tree.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


ORACLES["op8_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, d.e)]), 0) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op9_mixing_sources"] = mixing.MIX_SQL


@query
def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data; tested for distinctness, coreference, format and untouched rest."""
    docs = table(spark, sf_dir, "documents")
    return pii.replace_all(docs).select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens; tested against best fit one by one and the tokenizers library."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as 16 codes of codebooks refined over all vectors."""
    return part_codes.compress(table(spark, sf_dir, "embeddings"))


def _assigned(name: str, book: str) -> str:
    """SQL of the nearest entry of every part, ties to the lower index."""
    far = "list_dot_product(s, s) - 2 * list_dot_product(s, c) + list_dot_product(c, c)"
    return f"""{name} AS (SELECT rn, p, any_value(s) AS s, min({{'d': {far}, 'k': k}}) AS m FROM parts JOIN {book} USING (p) GROUP BY rn, p)"""


def _refined(name: str, assigned: str, book: str) -> str:
    """SQL of the entries after one round: floors of means, entries without parts stay."""
    return f"""{name} AS (
  SELECT p, k, coalesce(any_value(e), any_value(c)) AS c FROM {book} LEFT JOIN (
    SELECT p, k, list(floor(t / n) ORDER BY i) AS e FROM (
      SELECT p, m.k AS k, i, sum(s[i + 1]) AS t, count(*) AS n FROM {assigned}, (SELECT unnest(range(len(c))) AS i FROM {book} WHERE p = 0 AND k = 0) GROUP BY ALL) GROUP BY p, k) USING (p, k)
  GROUP BY p, k)"""


ORACLES["op12_vector_codes"] = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rn, vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT rn, p, e[CAST(p * len(e) // 16 + 1 AS BIGINT):CAST((p + 1) * len(e) // 16 AS BIGINT)] AS s FROM v, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, CAST(rn - 1 AS INTEGER) AS k, s AS c FROM parts WHERE rn <= 64),
{_assigned("a0", "b0")}, {_refined("b1", "a0", "b0")}, {_assigned("a1", "b1")}, {_refined("b2", "a1", "b1")}, {_assigned("a2", "b2")},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM a2 JOIN v USING (rn) GROUP BY rn, vec_id),
digest AS (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) FOR x IN c], ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent spelling that each stands for."""
    return variants.spelling_variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


ORACLES["op13_spelling_variants"] = r"""
WITH RECURSIVE checks AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY id, run),
hexed AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || [CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(len(x) // 2)], lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS h
  FROM hexed, checks),
worn AS (SELECT CASE WHEN h % 31 = 0 THEN run[:CAST(h % length(run) AS BIGINT)] || run[CAST(h % length(run) + 2 AS BIGINT):] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM worn WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS m, arg_min(other, (-n, other)) AS other FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS at FROM formed UNION ALL SELECT up.word, f.form FROM up JOIN formed f ON f.word = up.at WHERE f.form IS NOT NULL)
SELECT formed.*, up.at AS root FROM formed JOIN up USING (word) WHERE up.at IN (SELECT word FROM formed WHERE form IS NULL)
"""

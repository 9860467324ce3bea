"""Language identification by string kernels: presence of blended-spectrum n-grams, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tallgene.llm.batches import text_slices, texts_of
from tallgene.llm.hashing import mix

#: Buckets of the n-grams of 1, 2 and 3 characters.
SPECTRUM = (1 << 10, 1 << 12, 1 << 14)
WIDTH = sum(SPECTRUM)
UNKNOWN = "und"
#: Languages that are learned, the most frequent ones.
LANGUAGES = 1000


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages: normalised landmarks times the ridge solution


def presence(texts: list[str]) -> np.ndarray:
    """Texts x buckets: 1 where an n-gram of the lower-cased text falls, rows scaled to length 1. Their products are the kernel."""
    coded = [x.lower().encode("utf-32-le", "surrogatepass") for x in texts]
    sizes = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
    chars = np.frombuffer(b"".join(coded), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros((len(texts), WIDTH), np.float32)
    gram, offset = np.zeros(len(chars), np.uint64), 0
    for order, buckets in enumerate(SPECTRUM):
        n = len(chars) - order
        if n <= 0:
            break
        gram = (gram[:n] << np.uint64(21)) | chars[order:]
        whole = row[:n] == row[order:]
        out[row[:n][whole], offset + (mix(gram[whole]) % np.uint64(buckets)).astype(np.int64)] = 1
        offset += buckets
    return out / np.sqrt(np.maximum(1, out.sum(1, keepdims=True)))


def train(texts: list[str], languages: list[str], *, landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """One-versus-rest ridge regression on k(x, Z) K_ZZ^(-1/2); the landmarks Z are spread evenly over the rows given."""
    names = sorted(set(languages))
    x = np.concatenate([presence(texts[i : i + 64]) for i in range(0, len(texts), 64)])
    z = x[np.unique(np.linspace(0, len(x) - 1, min(landmarks, len(x))).astype(int))]
    values, vectors = np.linalg.eigh((z @ z.T).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ z.T).astype(float) @ root
    sizes = {n: languages.count(n) for n in names}
    weight = np.array([len(languages) / (len(names) * sizes[n]) for n in languages])[:, None]
    y = np.array([[1.0 if n == own else -1.0 for n in names] for own in languages])
    solved = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(x) * np.eye(phi.shape[1]), phi.T @ (weight * y))
    return Model(names, (z.T.astype(float) @ (root @ solved)).astype(np.float32))


def fit(labelled: DataFrame, *, per_language: int = 250, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Fit on at most ``per_language`` rows of each language, those with the smallest hash of ``key``, of LANGUAGES languages. Rows without language or
    without a letter take no part; None if none is left."""
    known = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    sizes = F.broadcast(known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES))
    hashed = F.xxhash64(F.lit("language"), F.col("k"))
    share = F.pmod(hashed, F.lit(1 << 32)).cast("double") / float(1 << 32)  # four times the rows that are taken, so that the sort sees few
    rows = known.join(sizes, "l").where((share * F.col("count") < 4 * per_language) & F.col("t").rlike(r"\p{L}"))
    nth = F.row_number().over(W.Window.partitionBy("l").orderBy(share, "k", "t"))
    taken = rows.withColumn("n", nth).where(F.col("n") <= per_language).orderBy("n", "l").collect()
    return train([r["t"] for r in taken], [r["l"] for r in taken]) if taken else None


def predict(docs: DataFrame, model: Model | None, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (0 to 1: the best language's regression value, -1 to 1, as a share) of whole texts.

    Texts that are null or hold no letter are "und" with score 0, as all are without a model. Equal values go to the language
    that sorts first; repeated rows stay rows. Texts are scored in batches by one matrix product; the model, of fixed size a
    language, is broadcast. There is no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for big in text_slices(batch, "__text", 300_000):
                for start in range(0, big.num_rows, 128):
                    part = big.slice(start, 128)
                    if m is None:
                        best, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                    else:
                        value = presence(texts_of(part, "__text")) @ m.weights
                        best = [m.languages[i] for i in value.argmax(1)]
                        score = np.clip((value.max(1) + 1) / 2, 0, 1).astype(float)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(best, pa.string()), pa.array(score)], names=[*part.schema.names[:-1], "lang_pred", "score"])

    slim = docs.select(*keep, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters"), F.col(text).alias("__text"))
    fields = [*slim.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    scored = slim.mapInArrow(run, T.StructType(fields))
    known = F.col("__letters")
    return scored.select(*keep, F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"))

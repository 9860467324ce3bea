"""A convolutional text classifier over hashed word embeddings, with thresholds calibrated by language."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgene.llm.batches import frugal, text_slices, texts_of
from tallgene.llm.hashing import Words, joined

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
#: Toxic and clean texts that a threshold of its own needs.
ENOUGH = 25
#: Logits are counted in bins of 1 / PER_UNIT between -LIMIT and LIMIT to set thresholds; those beyond count in the outermost bins.
LIMIT, PER_UNIT = 30, 64
BINS = 2 * LIMIT * PER_UNIT
#: A word is embedded by itself and by its beginnings of so many bytes.
BEGINNINGS = (4, 6, 8)
# Frequent function words by which a text's language group is told; a text without any is of no group.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine zu den mit von",
    "en": "the of and to in is that it was for with are",
    "es": "el los las que y por para una del con su es",
    "fr": "le les des et est une dans qui pas sur du au",
}
LETTERS = np.zeros(256, np.uint8)
LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTERS[128:] = np.arange(128, 256)


def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    words, groups = [], []
    for g, listed in enumerate(FUNCTION_WORDS.values()):
        words += listed.split()
        groups += [g] * len(listed.split())
    h = Words(" ".join(words).encode(), LETTERS).hashes()
    order = np.argsort(h)
    return h[order], np.array(groups)[order]


FUNCTION_HASH, FUNCTION_GROUP = _function_hashes()


@dataclass
class Model:
    """Weights and, by language group with "none" last, the score that counts as toxic."""

    embed: np.ndarray  # buckets x dim
    conv: list[np.ndarray]  # by width: (width * dim) x filters
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    threshold: np.ndarray


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of every word (words x pieces), first word of every text with the end, and each text's language group."""
    raw, offsets = joined([x.lower().encode("utf-8", "surrogatepass") for x in texts], b" ")
    w = Words(raw, LETTERS)
    whole = w.hashes()
    pieces = [whole, *[w.hashes(w.start, np.minimum(w.end, w.start + k), k) for k in BEGINNINGS]]
    buckets = np.stack([(p % np.uint64(BUCKETS)).astype(np.int32) for p in pieces], axis=1)
    first = w.firsts(offsets)
    at = np.minimum(np.searchsorted(FUNCTION_HASH, whole), len(FUNCTION_HASH) - 1)
    hit = np.flatnonzero(FUNCTION_HASH[at] == whole)
    text = np.searchsorted(first, hit, side="right") - 1
    votes = np.zeros((len(texts), len(FUNCTION_WORDS)))
    np.add.at(votes, (text, FUNCTION_GROUP[at[hit]]), 1)
    group = np.where(votes.sum(1) > 0, votes.argmax(1), len(FUNCTION_WORDS))
    return buckets, first, group


def _padded(buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with max(WIDTHS) - 1 empty words (-1) behind every text, so that no window crosses texts, and where texts begin."""
    gap, n = max(WIDTHS) - 1, len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    at = np.arange(len(buckets)) + text * (gap + 1)
    out = np.full((len(buckets) + n * (gap + 1), buckets.shape[1]), -1, np.int32)
    out[at] = buckets
    return out, first[:-1] + np.arange(n) * (gap + 1)


def forward(m: Model, rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pooled filters of every text, where each filter is largest, and the word vectors. Every text owns at least one row."""
    words = (m.embed[rows].sum(1) * (rows[:, :1] >= 0)).astype(np.float32)
    pooled, where = [], []
    for width, weights in zip(WIDTHS, m.conv, strict=True):
        value = words @ weights[:DIM]
        for k in range(1, width):
            value[:-k] += words[k:] @ weights[k * DIM : (k + 1) * DIM]
        top = np.maximum.reduceat(value, begin, axis=0)
        pooled.append(top)
        where.append(value)
    return np.concatenate(pooled, 1), where, words


def raw_scores(m: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Logit of every text and its language group."""
    buckets, first, group = features(texts)
    rows, begin = _padded(buckets, first)
    pooled = forward(m, rows, begin)[0] + m.bias
    return np.maximum(pooled, 0) @ m.dense + m.offset, group


def _argmax(value: np.ndarray, top: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Row of the first maximum of each text and filter."""
    text = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(value)]))
    at = np.where(value == top[text], np.arange(len(value))[:, None], len(value))
    return np.minimum.reduceat(at, begin, axis=0)


def train(texts: list[str], labels: np.ndarray, *, epochs: int = 8, batch: int = 32, seed: int = 7) -> Model:
    """Adagrad on the logistic loss; half of each batch is toxic, words are dropped at random, gradients follow the largest windows only."""
    rng = np.random.default_rng(seed)
    n_out = FILTERS * len(WIDTHS)
    m = Model(
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_out, np.float32), rng.normal(0, 0.3, n_out).astype(np.float32), 0.0, np.full(len(FUNCTION_WORDS) + 1, 0.5),
    )
    toxic, clean = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(toxic) or not len(clean):
        m.dense[:], m.offset = 0, 4.0 if len(toxic) else -4.0
        return m
    seen = [features([t])[0] for t in texts]
    grow = {"embed": np.full(BUCKETS, 1e-3, np.float32), "conv": [np.full_like(c, 1e-3) for c in m.conv], "bias": np.full(n_out, 1e-3), "dense": np.full(n_out, 1e-3), "offset": 1e-3}
    steps = max(300, epochs * len(texts) // batch)
    for step in range(steps):
        rate = 0.08 * (1 - step / steps) + 0.005
        pick = np.r_[rng.choice(toxic, batch // 2), rng.choice(clean, batch // 2)]
        parts = [seen[i][rng.random(len(seen[i])) > 0.1] for i in pick]
        rows, begin = _padded(np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])])
        pooled, values, words = forward(m, rows, begin)
        active = pooled + m.bias
        hidden = np.maximum(active, 0)
        z = np.clip(hidden @ m.dense + m.offset, -30, 30)
        error = (1 / (1 + np.exp(-z)) - labels[pick]) / len(pick)
        back = error[:, None] * m.dense * (active > 0)
        for name, g in (("dense", hidden.T @ error + 1e-4 * m.dense), ("bias", back.sum(0))):
            grow[name] += g * g
            setattr(m, name, (getattr(m, name) - rate * g / np.sqrt(grow[name])).astype(np.float32))
        grow["offset"] += error.sum() ** 2
        m.offset -= rate * error.sum() / np.sqrt(grow["offset"])
        to_words: list[tuple[np.ndarray, np.ndarray]] = []
        for j, width in enumerate(WIDTHS):
            own = slice(j * FILTERS, (j + 1) * FILTERS)
            at = _argmax(values[j], pooled[:, own], begin)
            g_conv = np.zeros_like(m.conv[j])
            for k in range(width):
                place, part = np.minimum(at + k, len(rows) - 1), slice(k * DIM, (k + 1) * DIM)
                g_conv[part] = np.einsum("tfd,tf->df", words[place], back[:, own])
                to_words.append((place.ravel(), (back[:, own, None] * m.conv[j][part].T[None]).reshape(-1, DIM)))
            grow["conv"][j] += g_conv * g_conv
            m.conv[j] -= (rate * g_conv / np.sqrt(grow["conv"][j])).astype(np.float32)
        place, g = np.concatenate([p for p, _ in to_words]), np.concatenate([x for _, x in to_words])
        real = rows[place, 0] >= 0
        buckets = rows[place[real]]
        touched, inverse = np.unique(buckets.ravel(), return_inverse=True)
        g_embed = np.zeros((len(touched), DIM))
        np.add.at(g_embed, inverse, np.repeat(g[real], buckets.shape[1], axis=0))
        grow["embed"][touched] += (g_embed * g_embed).mean(1)
        m.embed[touched] -= (rate * g_embed / np.sqrt(grow["embed"][touched])[:, None]).astype(np.float32)
    return m


def binned(z: np.ndarray) -> np.ndarray:
    """Bin of each logit."""
    return np.clip(np.floor((z + LIMIT) * PER_UNIT), 0, BINS - 1).astype(np.int64)


def set_thresholds(m: Model, counts: np.ndarray) -> None:
    """Thresholds from ``counts`` (language groups x bins x clean and toxic): per group the cut with the best balance of caught
    and wrongly rejected texts; a group with fewer than ENOUGH of either label takes the cut of all."""

    def best(own: np.ndarray) -> float:
        clean, toxic = own.T.astype(float)
        caught, wrong = (x.sum() - np.r_[0, np.cumsum(x)] for x in (toxic, clean))
        f1 = 2 * caught / np.maximum(1, caught + wrong + toxic.sum())
        top = np.flatnonzero(f1 >= f1.max() - 1e-9)
        at = int(top[len(top) // 2])
        return at / PER_UNIT - LIMIT if at else -LIMIT - 1.0

    whole = counts.sum(0)
    overall = best(whole) if whole.sum(0).all() else 0.0
    cuts = np.array([best(own) if own.sum(0).min() >= ENOUGH else overall for own in counts])
    m.threshold = 1 / (1 + np.exp(-cuts))


def no_counts() -> np.ndarray:
    return np.zeros((len(FUNCTION_WORDS) + 1, BINS, 2), np.int64)


def calibrate(m: Model, texts: list[str], labels: np.ndarray) -> None:
    """Thresholds over ``texts``."""
    z, group = raw_scores(m, texts)
    counts = no_counts()
    np.add.at(counts, (group, binned(z), labels), 1)
    set_thresholds(m, counts)


def labelled(labels: DataFrame, *, label: str = "toxic", key: str = "doc_id") -> DataFrame:
    """(key, label) of the rows that take part: labels 0 and 1 of documents with a key."""
    return labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key), F.col(label).cast("int").alias(label))


def sample(labels: DataFrame, per_label: int, *, label: str = "toxic", key: str = "doc_id") -> DataFrame:
    """(key, label) of at most ``per_label`` rows of each label, those with the smallest hash of ``key``."""
    rows = labelled(labels, label=label, key=key)
    order = F.xxhash64(F.lit("toxicity"), F.col(key))
    return rows.where(F.col(label) == 0).orderBy(order, key).limit(per_label).unionByName(rows.where(F.col(label) == 1).orderBy(order, key).limit(per_label))


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = 2000, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Model:
    """Weights from the documents of a bounded ``sample`` of ``labels``, three quarters of it by hash; thresholds from all labelled documents.

    Labels other than 0 and 1 and documents without text take no part; no rows give a model that rejects nothing. The sample's
    keys are broadcast (``per_label`` a label at most), so documents are read and not shuffled. One task trains on the sample;
    the driver gets the weights alone. Then all documents are scored and counted, see ``counted``.
    """
    chosen = F.broadcast(sample(labels, per_label, label=label, key=key))
    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t")).join(chosen, key)
    taken = rows.select(F.xxhash64(F.lit("toxicity"), F.col(key)).alias("h"), F.col(label).alias("y"), "t").repartition(1)
    packed = taken.mapInPandas(frugal(_trained), "model binary").collect()
    if not packed:
        return train([], np.zeros(0))
    m = pickle.loads(packed[0]["model"])
    set_thresholds(m, counted(docs, labels, m, text=text, label=label, key=key))
    return m


def counted(docs: DataFrame, labels: DataFrame, model: Model, *, text: str = "text", label: str = "toxic", key: str = "doc_id") -> np.ndarray:
    """Pairs of a label and a document of its key by language group of the text, bin of the logit and label.

    Every text is scored where it is read; keys, groups and bins alone meet the labels, of which a key has one row. The driver gets
    one row a group and bin at most.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text", 500_000):
                z, group = raw_scores(sent.value, texts_of(part, "__text"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(group.astype(np.int32)), pa.array(binned(z).astype(np.int32))], names=[part.schema.names[0], "__group", "__bin"])

    slim = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, F.col(text).alias("__text"))
    scored = slim.mapInArrow(frugal(run), T.StructType([slim.schema.fields[0], T.StructField("__group", T.IntegerType()), T.StructField("__bin", T.IntegerType())]))
    own = labelled(labels, label=label, key=key).groupBy(key).agg(F.sum(1 - F.col(label)).alias("__clean"), F.sum(label).alias("__toxic"))
    rows = scored.join(own, key).groupBy("__group", "__bin").agg(F.sum("__clean").alias("__clean"), F.sum("__toxic").alias("__toxic"))
    counts = no_counts()
    for r in rows.collect():
        counts[r["__group"], r["__bin"]] = r["__clean"], r["__toxic"]
    return counts


def _trained(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model of all rows (h, y, t) as one binary value; nothing without rows."""
    sample = [p for p in parts if len(p)]
    if sample:
        rows = pd.concat(sample).sort_values(["h", "y", "t"])
        yield pd.DataFrame({"model": [pickle.dumps(_model(rows["t"].tolist(), rows["y"].to_numpy(np.int64)))]})


def _model(texts: list[str], y: np.ndarray) -> Model:
    held = np.arange(len(texts)) % 4 == 3
    return train([t for t, h in zip(texts, held, strict=True) if not h], y[~held])


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1, 0.5 at the threshold of the text's language group) and ``predicted`` of whole texts.

    Only the text is looked at. Null and empty texts are scored as texts without words; repeated rows stay rows. The model,
    of fixed size, is broadcast; there is no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        cuts = np.log(m.threshold / (1 - m.threshold))
        for batch in batches:
            for part in text_slices(batch, "__text", 500_000):
                z, group = raw_scores(m, texts_of(part, "__text"))
                s = 1 / (1 + np.exp(-np.clip(z - cuts[group], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s.astype(float)), pa.array((s >= 0.5).astype(np.int32))], names=[*part.schema.names[:-1], "score", "predicted"])

    slim = docs.select(*keep, F.col(text).alias("__text"))
    return slim.mapInArrow(frugal(run), T.StructType([*slim.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))

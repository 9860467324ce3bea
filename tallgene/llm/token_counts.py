"""Token counts of texts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgene.llm import bpe
from tallgene.llm.batches import text_slices, texts_of

#: Counts of pre-tokens that a Python worker remembers; the memory starts afresh beyond it, results do not depend on it.
REMEMBERED = 1_000_000


@lru_cache(maxsize=1)
def _memory(vocabulary: str) -> dict[str, int]:
    return dict.fromkeys(bpe.load(vocabulary).special, 1)


def _counts(vocabulary: bpe.ByteBpe, texts: list[str], known: dict[str, int]) -> list[int]:
    split = [vocabulary.pieces(t) for t in texts]
    fresh = list(set().union(*split).difference(known)) if split else []
    if len(known) + len(fresh) > REMEMBERED:
        known.clear()
        known.update(dict.fromkeys(vocabulary.special, 1))
        fresh = list(set().union(*split).difference(known))
    if fresh:
        known.update(zip(fresh, vocabulary.merge(fresh)[1].tolist(), strict=True))
    return [sum(map(known.__getitem__, words)) for words in split]


def count_tokens(docs: DataFrame, vocabulary: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = 512) -> DataFrame:
    """``keep`` columns with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each whole text.

    ``vocabulary`` is the path of a byte-level file in the tokenizers format. A special token inside a text counts as one.
    A null or empty text has 0 bytes and 0 tokens. Repeated rows stay rows; an empty table gives an empty one. No shuffle:
    each task splits slices of bounded text, merges the pre-tokens it has not met, and adds up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _memory(vocabulary)
        for batch in batches:
            for part in text_slices(batch, "__text"):
                counts = _counts(bpe.load(vocabulary), texts_of(part, "__text"), known)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.array(counts, np.int64))], names=[*part.schema.names[:-1], "n_tokens"])

    slim = docs.select(*keep, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).alias("__text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    return slim.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)

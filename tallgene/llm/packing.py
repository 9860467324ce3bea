"""Best-fit packing of token sequences, planned over the histogram of lengths.

Which document goes where depends on its length alone, so the plan is made over counts of lengths: at most ``capacity``
numbers, whatever the corpus. Documents then take planned slots by their rank among the documents of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tallgene.llm import bpe
from tallgene.llm.batches import text_slices, texts_of
from tallgene.llm.graph import kept
from tallgene.llm.lexicon import ragged_take

#: Pre-tokens whose ids a Python worker remembers; the memory starts afresh beyond it, results do not depend on it.
REMEMBERED = 500_000
#: Rows of one length in a shard, about, and ranks of one length that a slot row covers at most.
SHARD_ROWS, RANKS = 1000, 1024


class Ids:
    """Ids of the pre-tokens met so far, as runs of one pool. Number 0 is the run that ends a document."""

    def __init__(self, vocabulary: bpe.ByteBpe, end: int):
        self.vocabulary, self.end = vocabulary, end
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.start, self.size = np.array([self.end], np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)
        self._add(list(self.vocabulary.special), np.fromiter(self.vocabulary.special.values(), np.int64), np.ones(len(self.vocabulary.special), np.int64))

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.start)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        self.start = np.r_[self.start, len(self.pool) + np.cumsum(counts) - counts]
        self.size, self.pool = np.r_[self.size, counts], np.r_[self.pool, ids]

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end behind it, flat, and how many each text has."""
        split = [self.vocabulary.pieces(x) for x in texts]
        fresh = list(set().union(*split).difference(self.number))
        if len(self.number) + len(fresh) > REMEMBERED:
            self._clear()
            fresh = list(set().union(*split).difference(self.number))
        if fresh:
            self._add(fresh, *self.vocabulary.merge(fresh))
        places: list[int] = []
        ends = []
        for words in split:
            places += map(self.number.__getitem__, words)
            places.append(0)
            ends.append(len(places))
        at = np.array(places, np.int64)
        sizes = self.size[at]
        total = np.cumsum(sizes)[np.array(ends, np.int64) - 1]
        return self.pool[ragged_take(self.start[at], sizes)], np.diff(np.r_[0, total])


@lru_cache(maxsize=1)
def _ids(path: str, end: int) -> Ids:
    return Ids(bpe.load(path), end)


def pieces(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end: int = 0, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ids: bool = False) -> DataFrame:
    """``keep`` columns with ``piece``, ``start``, ``length`` and ``ids_crc32``, on request also ``ids`` (array of int), of every piece.

    A document is the ids of its whole text and ``end``. One of more than ``capacity`` ids is cut into pieces of that many, the
    last one maybe shorter; no other one is. Null and empty texts are the end alone. Repeated rows stay rows; no shuffle.
    """
    slim = docs.select(*keep, F.col(text).alias("__text"))
    more = [T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]
    schema = T.StructType([*slim.schema.fields[:-1], *more, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ids(vocabulary, end)
        for batch in batches:
            for part in text_slices(batch, "__text"):
                flat, sizes = known.of(texts_of(part, "__text"))
                flat = flat.astype("<u4")
                cut = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), cut)
                number = ragged_take(np.zeros(len(sizes), np.int64), cut)
                length = np.minimum(sizes[row] - number * capacity, capacity)
                at = np.r_[0, np.cumsum(length)]
                raw = memoryview(flat).cast("B") if len(flat) else b""
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                made = [pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array(length), pa.array(crc, pa.int64())]
                if ids:
                    made.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in part.columns[:-1]), *made], names=schema.names)

    return slim.mapInArrow(run, schema)


def best_fit(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Slots of best-fit decreasing over counts: (length, rank, sequence_id, bins, each, offset).

    The items of ``length`` with ranks from ``rank`` on fill ``bins`` sequences from ``sequence_id`` on, ``each`` items a sequence, from
    ``offset`` on. Sequences of one free room are runs of numbers, so an item goes where it would one by one: into the fullest
    sequence that has room, which then is the fullest again. A run is split at most twice by a length, and each fill at
    least halves the room of a run: rows stay below a fixed number for a capacity, whatever the counts.
    """
    rows, made = [], 0
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        left, rank, r = histogram[length], 0, length
        while left:
            while r < capacity and not room[r]:
                r += 1
            if r >= capacity:  # no open sequence has room
                r = capacity
                first, n = made, -(-left // (capacity // length))
                made += n
            else:
                first, n = room[r].pop()
            each = r // length
            full = min(n, left // each)
            for begin, bins, items in ((first, full, each), (first + full, int(full < n), min(left - full * each, each))):
                if bins and items:
                    rows.append((length, rank, begin, bins, items, capacity - r))
                    room[r - items * length].append((begin, bins))
                    rank, left, first, n = rank + bins * items, left - bins * items, begin + bins, n - bins
            if n:
                room[r].append((first, n))
    return pd.DataFrame(rows, columns=["length", "rank", "sequence_id", "bins", "each", "offset"], dtype="int64")


def _ranked(rows: DataFrame, counts: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``__rank`` from 0 within their ``length``, of which ``counts`` are (length, n).

    A length may hold most rows: its rows are spread by hash over as many shards as their number asks for, and counts of shards give
    each shard its first rank.
    """
    shards = F.broadcast(counts.select("length", F.ceil(F.col("n") / SHARD_ROWS).alias("__n")))  # as many rows as there are lengths
    dealt = rows.withColumn("__h", F.xxhash64(*order)).join(shards, "length").withColumn("__shard", F.pmod("__h", "__n")).drop("__n")
    of_shard = kept(dealt.groupBy("length", "__shard").agg(F.count(F.lit(1)).alias("n")), "shards")
    before = F.sum("n").over(W.Window.partitionBy("length").orderBy("__shard").rowsBetween(W.Window.unboundedPreceding, -1))
    first = of_shard.select("length", "__shard", F.coalesce(before, F.lit(0)).alias("__first"))
    nth = F.row_number().over(W.Window.partitionBy("length", "__shard").orderBy("__h", *order))
    ranked = dealt.withColumn("__nth", nth).join(first, ["length", "__shard"]).withColumn("__rank", F.col("__first") + F.col("__nth") - 1)
    return ranked.drop("__h", "__shard", "__first", "__nth")


def slots(spark: SparkSession, plan: pd.DataFrame) -> DataFrame:
    """The plan as rows for an equi join: one for every RANKS ranks of a length that a run of slots covers."""
    table = spark.createDataFrame(plan, "length long, rank long, sequence_id long, bins long, each long, offset long")
    last = F.col("rank") + F.col("bins") * F.col("each") - 1
    blocks = F.sequence(F.floor(F.col("rank") / RANKS), F.floor(last / RANKS))
    return table.select("length", "rank", "sequence_id", "each", "offset", last.alias("last"), F.explode(blocks).alias("block"))


def pack(rows: DataFrame, order: list[str], capacity: int = 2048) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: every row's place in sequences of at most ``capacity``, gapless from 0.

    ``length`` is a row's size, from 1 to ``capacity``; null or other lengths are an error. ``order`` names columns that tell rows
    apart: rows equal in all of them take their slots in any order. ``rows`` is read three times, so it should be a written
    table. The driver holds the counts of at most ``capacity`` lengths and the plan made of them. An empty table stays empty.
    """
    wrong = F.raise_error(F.lit(f"lengths must be from 1 to {capacity}"))
    rows = rows.withColumn("length", F.when(F.col("length").between(1, capacity), F.col("length").cast("long")).otherwise(wrong.cast("long")))
    counts = kept(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    ranked = _ranked(rows, counts, order)
    planned = slots(rows.sparkSession, best_fit({r["length"]: r["n"] for r in counts.collect()}, capacity))
    s = planned.select(*[F.col(c).alias(f"__s_{c}") for c in planned.columns])
    here = (F.col("length") == F.col("__s_length")) & (F.floor(F.col("__rank") / RANKS) == F.col("__s_block")) & F.col("__rank").between(F.col("__s_rank"), F.col("__s_last"))
    nth = F.col("__rank") - F.col("__s_rank")
    return ranked.join(s, here).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        (F.col("__s_sequence_id") + F.floor(nth / F.col("__s_each"))).alias("sequence_id"), (F.col("__s_offset") + nth % F.col("__s_each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """Pieces of all documents, encoded once and written, with their places; with ``ids`` they can be joined to sequences.

    Columns: doc_id, piece, start, length, ids_crc32, on request ids, sequence_id, offset. Other columns of ``docs`` are not read.
    """
    cut = kept(pieces(docs, vocabulary, capacity=capacity, end=end, ids=ids), "pieces")
    return pack(cut, ["doc_id", "piece", "ids_crc32", "length"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, ids in place and the documents of their pieces in order.

    A group holds at most the capacity of one sequence.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return grouped.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))

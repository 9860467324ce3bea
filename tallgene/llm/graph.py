"""Connected components and fixed-size key filters as DataFrame jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgene.functions.lineage import scratch_path
from tallgene.llm.batches import frugal


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder once and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def most_frequent(counted: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows with the highest ``n`` of (value, n), ties by value.

    A histogram of the powers of two of n tells which rows can be among them, so that the sort sees few more than the limit.
    """
    counted = kept(counted, "counts")
    level = F.floor(F.log2("n"))
    rows = counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, seen = 0, 0
    for row in rows:
        least, seen = row["level"], seen + row["count"]
        if seen >= limit:
            break
    return counted.where(level >= least).orderBy(F.desc("n"), counted.columns[0]).limit(limit)


def bounded_sample(df: DataFrame, limit: int, rows: int, *key: str) -> DataFrame:
    """About ``limit`` of ``rows`` rows, by a hash of the key; all, if they are no more."""
    share = F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1 << 32)).cast("double") / float(1 << 32)
    return df.where(share * rows < limit)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges (a, b), longs.

    Rounds of large-star and small-star steps, each two aggregations with map-side minima, until a round changes nothing.
    Edges never multiply: a step moves every edge to a smaller node.
    """
    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every node of the large star keeps an edge to its lowest neighbour
        downward = kept(large.unionByName(lowest(both).where("u <> m").select("u", F.col("m").alias("v"))).distinct(), "edges")
        small = downward.join(lowest(downward), "u").select(F.col("v").alias("x"), "u", "m")
        after = kept(small.select(F.explode(F.array("x", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = after


class KeyFilter:
    """A bit map of 2 ** BITS bits over hashes of keys: tells keys that are surely absent. Its size is fixed."""

    BITS = 23

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _places(keys: np.ndarray) -> list[np.ndarray]:
        from tallgene.llm.hashing import mix

        h = mix(keys.astype(np.int64).view(np.uint64))
        mask = np.uint64((1 << KeyFilter.BITS) - 1)
        return [(h >> np.uint64(s)) & mask for s in (0, 23, 40)]

    @classmethod
    def of(cls, df: DataFrame, column: str) -> KeyFilter:
        """From all keys of a column: partial maps are joined by or, and at most 2 ** (BITS - 6) words reach the driver."""
        import pyarrow as pa

        def run(batches):
            bits = np.zeros(1 << cls.BITS, bool)
            for batch in batches:
                keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                for place in cls._places(keys):
                    bits[place] = True
            words = np.packbits(bits, bitorder="little").view(np.int64)
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(words[at])], names=["at", "word"])

        rows = df.select(F.col(column).cast("long")).mapInArrow(frugal(run), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
        words = np.zeros(1 << (cls.BITS - 6), np.int64)
        words[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
        return cls(words)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(self.words.view(np.uint8), bitorder="little").view(bool)
        return np.logical_and.reduce([bits[p] for p in self._places(keys)])

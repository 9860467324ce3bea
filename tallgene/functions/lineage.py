"""Lineage cuts and shared scratch folders that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = getattr(spark, "_tallgene_scratch", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="tallgene-")
        spark._tallgene_scratch = made
    return made


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """More partitions for an input that arrives in fewer splits than there are cores.

    Meant before steps that expand every row a lot; with many splits it changes nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


#: Rows of a task that keeps most of them in a hash table.
DEALT = 1 << 17


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """As many partitions as the number of rows asks for, so that what a task holds does not follow the size of a file's row groups."""
    return df.repartition(max(1, -(-df.count() // DEALT)), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, so lost executors do not lose it.

    Used for small derived tables (per group, gene, value or label) that later steps read several
    times, so that the large input behind them is scanned once.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()

"""User functions over samples (survey section 2.17)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap_output(samples, fn: Callable[[Column], Column], out: str = "output") -> DataFrame:
    """udf_output_wrapper: a user expression (built-in functions or a pandas UDF) over the items of a sample."""
    return samples.withColumn(out, fn(F.col("items")))


def score_batches(samples, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows_per_batch: int = 1024) -> DataFrame:
    """udf_batch_score: a user scoring function on batches of cells (cell_id, genes, values).

    It returns one row per cell with the columns of ``schema``; results are matched by the cell's key, so the
    order of batches does not matter. Batches are bounded, a partition is streamed through.
    """
    flat = samples.select("cell_id", F.col("items.gene").alias("genes"), F.col("items.value").alias("values"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows_per_batch):
                part = batch.iloc[at:at + rows_per_batch]
                scored = fn(part)
                if len(scored) != len(part):
                    raise ValueError("the scoring function must return one row per cell")
                yield scored

    return flat.mapInPandas(run, schema)

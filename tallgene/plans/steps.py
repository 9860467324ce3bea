"""Transforms by name, chains of them, and the two default chains (survey section 2.17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgene.operators import filters as fl
from tallgene.operators import harmonise as hz
from tallgene.operators import normalise as nm

REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "rename_genes": hz.rename_genes,
    "standardize_genes": hz.standardize_genes,
    "keep_genes": fl.keep_genes,
    "keep_vocab_genes": fl.keep_vocab_genes,
    "normalize_total": nm.normalize_total,
    "scale_counts": nm.scale_counts,
    "log": nm.log_transform,
    "median_normalize": nm.median_normalize,
    "tpm": nm.tpm,
    "bin_int_cast": nm.bin_int_cast,
    "bin_percentile": nm.bin_percentile,
    "bin_value": nm.bin_value,
    "filter_cells": fl.filter_cells,
    "filter_genes": fl.filter_genes,
}


def make_transform(name: str, **args) -> Callable[[DataFrame], DataFrame]:
    """udf_transform_registry: a transform by name with its arguments; an unknown name is an error."""
    if name not in REGISTRY:
        raise ValueError(f"unknown transform {name}")
    fn = REGISTRY[name]
    return lambda df: fn(df, **args)


def register_transform(name: str, fn: Callable[..., DataFrame]) -> None:
    REGISTRY[name] = fn


def compose(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """arr_compose for matrices: apply the configured steps in order, as one lazy plan."""
    for name, args in steps:
        df = df.transform(make_transform(name, **args))
    return df


def default_transforms(expr, var) -> DataFrame:
    """udf_default_transforms: rename, keep all, total 10 000, log2(1+x), integer bins, cell and gene filters.

    The ceil of a value already at an integer must not depend on the last bit of the log, hence round(9).
    """
    chain = [
        ("rename_genes", {"var": var, "gene_map": var}),
        ("keep_genes", {"genes": None}),
        ("normalize_total", {"target_sum": 10000.0}),
        ("log", {"base": 2}),
    ]
    out = compose(expr, chain).withColumn("value", F.round("value", 9))
    out = compose(out, [("bin_int_cast", {"num_bins": 10}), ("filter_cells", {"min_counts": 2}), ("filter_genes", {"min_counts": 1})])
    return out.select("cell_id", "gene", F.col("value").cast("bigint").alias("value"))


def perturbation_transforms(expr, var=None) -> DataFrame:
    """Default chain for perturbation data: rename, keep all, total 10 000, log2(1+x)."""
    out = expr if var is None else hz.rename_genes(expr, var, var)
    return compose(out, [("keep_genes", {"genes": None}), ("normalize_total", {"target_sum": 10000.0}), ("log", {"base": 2})])

"""Interval operators and range joins (survey section 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def promoters(genes, up: int = 1000, down: int = 1000) -> DataFrame:
    """rng_promoters: transcription start by strand; [tss - up, tss + down), not below zero."""
    tss = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    return genes.withColumn("_tss", tss).withColumns({
        "promoter_start": F.greatest(F.lit(0), F.col("_tss") - up), "promoter_end": F.col("_tss") + down,
    }).drop("_tss")


def bin_floor(col: str, resolution: int):
    """rng_bin_floor: coordinate on the bin grid."""
    return F.floor(F.col(col) / resolution) * resolution


def overlaps(a, b, width: int) -> DataFrame:
    """Pairs of overlapping intervals (chrom, start, end) against (chrom, bstart, bend).

    Both sides are spread over bins of ``width``, met by an equi join, and a pair is kept only in the
    bin of its later start, so it appears once. No nested loop, no chromosome-wide group.
    """
    def spread(df, s, e):
        last = F.floor((F.col(e) - 1) / width)
        return df.where(F.col(e) > F.col(s)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), last)))

    joined = spread(a, "start", "end").join(spread(b, "bstart", "bend"), ["chrom", "_bin"])
    hit = (F.col("start") < F.col("bend")) & (F.col("bstart") < F.col("end"))
    first = F.col("_bin") == F.floor(F.greatest("start", "bstart") / width)
    return joined.where(hit & first).drop("_bin")


def mean_signal(genes, signal, chrom_sizes, width: int = 10_000, out: str = "signal") -> DataFrame:
    """rng_mean_signal: mean signal over covered bases of each promoter; end capped at the chromosome, empty intervals
    skipped, no data = 0. Genes on chromosomes without signal are left out."""
    capped = genes.join(chrom_sizes.select("chrom", "size"), "chrom").select(
        "gene", "chrom", F.col("promoter_start").alias("start"), F.least("promoter_end", "size").alias("end")).where("start < end")
    track = signal.select("chrom", F.col("start").alias("bstart"), F.col("end").alias("bend"), "value")
    pairs = overlaps(capped, track, width)
    n = F.least("end", "bend") - F.greatest("start", "bstart")
    mean = pairs.groupBy("gene", "chrom", "start", "end").agg((F.sum(F.col("value") * n) / F.sum(n)).alias("_m"))
    return capped.join(mean, ["gene", "chrom", "start", "end"], "left").select("gene", F.coalesce("_m", F.lit(0.0)).alias(out))

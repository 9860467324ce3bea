"""Perturbation pairing and scores (survey section 2.13)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgene.functions.blocks import block_meetings
from tallgene.functions.lineage import stable
from tallgene.functions.lists import beside
from tallgene.functions.rand import hash_int, hash_uniform
from tallgene.functions.ranks import hash_ranks, quantiles
from tallgene.operators.stats import AVERAGE, plain_group_means

CONTROL = "Control"
BLOCK = 128


def _numbered_controls(obs, seed, col: str) -> tuple[DataFrame, Column]:
    controls = obs.where(F.col(col) == CONTROL).select("cell_id")
    m = controls.select(F.count("*")).scalar()
    return hash_ranks(controls, [], f"{seed}c", ["cell_id"], "_rn"), m


def pair_control(obs, seed=42, col="perturbation") -> DataFrame:
    """prt_pair_control: every perturbed cell with a random control; controls are numbered, the pair is an equi join."""
    controls, m = _numbered_controls(obs, seed, col)
    cells = obs.where(F.col(col) != CONTROL).withColumn("_rn", F.pmod(hash_int(seed, "cell_id"), m) + 1)
    return cells.join(controls.withColumnRenamed("cell_id", "control_id"), "_rn").drop("_rn")


def pair_cyclic(obs, chunk: int, seed=42, col="perturbation") -> DataFrame:
    """prt_pair_cyclic: inside a chunk of perturbed cells the controls follow each other from a hashed start."""
    controls, m = _numbered_controls(obs, seed, col)
    cells = hash_ranks(obs.where(F.col(col) != CONTROL), [], f"{seed}p", ["cell_id"], "_i")
    i = F.col("_i") - 1
    cells = cells.withColumn("chunk", F.floor(i / chunk))
    at = F.pmod(F.pmod(hash_int(seed, "chunk"), m) + F.pmod(i, F.lit(chunk)), m) + 1
    return cells.withColumn("_rn", at).join(controls.withColumnRenamed("cell_id", "control_id"), "_rn").drop("_rn", "_i")


def paired_genes(pairs, expr, col="perturbation") -> DataFrame:
    """One row per (cell, gene) seen in the perturbed cell, its control or the targets, with both values."""
    zero = F.lit(0.0)
    pairs = stable(pairs.select("cell_id", "control_id", col))
    perturbed = pairs.select("cell_id").join(expr, "cell_id").select(
        "cell_id", "gene", F.col("value").alias("label"), zero.alias("control"), F.lit(0).alias("target"))
    ctrl = expr.select(F.col("cell_id").alias("control_id"), "gene", F.col("value").alias("control"))
    control = pairs.select("cell_id", "control_id").join(ctrl, "control_id").select(
        "cell_id", "gene", zero.alias("label"), "control", F.lit(0).alias("target"))
    target = pairs.select("cell_id", F.explode(F.split(col, "_")).alias("gene"), zero.alias("label"), zero.alias("control"), F.lit(1).alias("target"))
    rows = perturbed.unionByName(control).unionByName(target)
    return rows.groupBy("cell_id", "gene").agg(
        F.sum("label").alias("label"), F.sum("control").alias("control"), F.max("target").alias("perturbed"))


def expose_zeros(paired, mode: str, all_genes=None, cells=None, seed=42, prob: float = 0.5) -> DataFrame:
    """prt_expose_zeros: which genes of a pair stay."""
    no_zeros = (F.col("control") != 0) | (F.col("perturbed") == 1)
    label_nonzeros = no_zeros | (F.col("label") != 0)
    if mode == "label_nonzeros":
        return paired.where(label_nonzeros)
    if mode == "no_zeros":
        return paired.where(no_zeros)
    if mode == "alternate":
        return paired.where(F.when(hash_uniform(seed, "cell_id") < prob, no_zeros).otherwise(label_nonzeros))
    if mode == "all":
        grid = beside(cells.select("cell_id"), all_genes, "gene", distinct=True)
        return grid.join(paired, ["cell_id", "gene"], "left").fillna(0)
    raise ValueError(f"unknown mode {mode}")


def pair_fields(paired, average=None) -> DataFrame:
    """prt_pair_fields: control value, flag, label, delta, and delta from the average perturbation (0 without one)."""
    out = paired.withColumn("delta", F.col("label") - F.col("control"))
    if average is None:
        return out.withColumn("delta_baseline", F.lit(0.0))
    joined = out.join(average.select("gene", F.col("mean").alias("_avg")), "gene", "left")
    return joined.withColumn("delta_baseline", F.col("label") - F.coalesce("_avg", F.lit(0.0))).drop("_avg")


def grouped_truth(means, remove_always_zero: bool = False) -> DataFrame:
    """prt_grouped_truth: gene x group means, optionally without genes that are zero in every group."""
    if not remove_always_zero:
        return means
    seen = means.groupBy("gene").agg(F.max((F.col("mean") != 0).cast("int")).alias("_nz")).where("_nz = 1")
    return means.join(seen, "gene", "left_semi")


def grouped_predictions(preds, truth, delta: bool = False) -> DataFrame:
    """prt_grouped_pred: perturbation x gene grid filled with the baseline, overwritten by mean predictions.

    Baseline is the train average if there is one, else Control; with ``delta`` the mean predicted
    delta is added to it. The gene list meets the perturbations in pieces, so only grid rows are made.
    """
    truth = stable(truth)
    value = "predicted_delta" if delta else "predicted"
    mean = stable(preds.groupBy("perturbation", "gene").agg(F.avg(value).alias("_p")))
    has_avg = truth.where(F.col("perturbation") == AVERAGE).select(F.count("*")).scalar() > 0
    base = truth.groupBy("gene").agg(
        F.max(F.when(F.col("perturbation") == AVERAGE, F.col("mean"))).alias("_a"),
        F.coalesce(F.max(F.when(F.col("perturbation") == CONTROL, F.col("mean"))), F.lit(0.0)).alias("input"),
    ).select("gene", "input", F.when(has_avg, F.coalesce("_a", F.lit(0.0))).otherwise(F.col("input")).alias("baseline"))
    grid = beside(mean.select("perturbation").distinct(), truth, "gene", distinct=True)
    out = grid.join(base, "gene").join(mean, ["perturbation", "gene"], "left").join(
        truth.select("perturbation", "gene", F.col("mean").alias("label")), ["perturbation", "gene"], "left")
    predicted = F.col("baseline") + F.coalesce("_p", F.lit(0.0)) if delta else F.coalesce("_p", "baseline")
    return out.select("perturbation", "gene", predicted.alias("predicted"), "input", "baseline",
                      F.coalesce("label", F.lit(0.0)).alias("label"))


METRICS = ["agg_pcc", "baseline_agg_pcc", "baseline_agg_pcc_from_avg", "delta_agg_pcc", "agg_mae", "baseline_agg_mae", "baseline_agg_mae_from_avg"]


def aggregated_metrics(grouped) -> DataFrame:
    """prt_agg_metrics: correlations and mean absolute errors of pseudobulk profiles per perturbation."""
    c = F.col
    return grouped.groupBy("perturbation").agg(
        F.corr("predicted", "label").alias("agg_pcc"), F.corr("input", "label").alias("baseline_agg_pcc"),
        F.corr("baseline", "label").alias("baseline_agg_pcc_from_avg"),
        F.corr(c("predicted") - c("input"), c("label") - c("input")).alias("delta_agg_pcc"),
        F.avg(F.abs(c("label") - c("predicted"))).alias("agg_mae"), F.avg(F.abs(c("label") - c("input"))).alias("baseline_agg_mae"),
        F.avg(F.abs(c("label") - c("baseline"))).alias("baseline_agg_mae_from_avg"))


def top_gene_metrics(grouped, top_genes, least: int = 2) -> DataFrame:
    """prt_top20_metrics: the same on each perturbation's top genes (at least two), plus a mean row."""
    sub = grouped.join(top_genes.select("perturbation", "gene"), ["perturbation", "gene"], "left_semi")
    sub = stable(sub)
    enough = sub.groupBy("perturbation").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    one = aggregated_metrics(sub.join(enough, "perturbation", "left_semi"))
    mean = one.agg(*[F.avg(m).alias(m) for m in METRICS]).withColumn("perturbation", F.lit("mean"))
    return one.unionByName(mean)


def top_gene_deltas(preds, top_genes, control) -> DataFrame:
    """prt_top20_delta: predicted and true minus control mean for the top genes, per gene mean and box statistics."""
    sub = preds.join(top_genes.select("perturbation", "gene"), ["perturbation", "gene"], "left_semi").join(
        control.select("gene", F.col("mean").alias("_c")), "gene", "left")
    base = F.coalesce("_c", F.lit(0.0))
    long = sub.select("perturbation", "gene", F.explode(F.array(
        F.struct(F.lit("predicted").alias("kind"), (F.col("predicted") - base).alias("x")),
        F.struct(F.lit("label").alias("kind"), (F.col("label") - base).alias("x")))).alias("v")).select("perturbation", "gene", "v.*")
    keys = ["perturbation", "gene", "kind"]
    box = quantiles(long, keys, "x", {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})
    return long.groupBy(*keys).agg(F.avg("x").alias("mean")).join(box, keys)


def profile_arrays(grid, *values: str, name: str = "perturbation") -> DataFrame:
    """One row per group with dense profiles in gene order (length bounded by the gene list)."""
    items = F.array_sort(F.collect_list(F.struct("gene", *values))).alias("i")
    return grid.groupBy(name).agg(items).select(name, F.col("i.gene").alias("genes"), *[F.col(f"i.{v}").alias(v) for v in values])


def discrimination_scores(grouped, block: int = BLOCK) -> DataFrame:
    """prt_discrimination: 1 - (number of truths closer in L1 than the own truth) / P, target genes left out.

    Profiles are cut into blocks of ``block`` perturbations; each pair of blocks is one small dense
    product in numpy that returns a count per prediction. No pair of perturbations becomes a row. The
    profiles (one row per perturbation) are checkpointed, because every block pair reads them.
    """
    profiles = stable(profile_arrays(grouped, "predicted", "label"))

    def count_closer(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        truth, names = np.vstack(q["label"].to_list()), q["perturbation"].to_numpy()
        out = []
        for name, genes, pred, own in zip(p["perturbation"], p["genes"], p["predicted"], p["label"]):
            keep = ~np.isin(np.asarray(genes, dtype=object), name.split("_"))
            dist = np.round(np.abs(truth[:, keep] - np.asarray(pred)[keep]).sum(axis=1), 9)
            mine = np.round(np.abs(np.asarray(own)[keep] - np.asarray(pred)[keep]).sum(), 9)
            out.append((name, int(((dist < mine) & (names != name)).sum()), float(mine)))
        return pd.DataFrame(out, columns=["perturbation", "closer", "distance"])

    counted = block_meetings(profiles, "perturbation", block, count_closer, "perturbation string, closer long, distance double")
    n = profiles.select(F.count("*")).scalar()
    return counted.groupBy("perturbation").agg(F.sum("closer").alias("closer"), F.max("distance").alias("distance")).withColumn(
        "score", 1 - F.col("closer") / n)


def add_predicted(preds, truth) -> DataFrame:
    """prt_delta_to_expr: prediction = train average + predicted delta."""
    avg = truth.where(F.col("perturbation") == AVERAGE).select("gene", F.col("mean").alias("_a"))
    return preds.join(avg, "gene", "left").withColumn("predicted", F.coalesce("_a", F.lit(0.0)) + F.col("predicted_delta")).drop("_a")


def fill_matrix(preds, grouped) -> DataFrame:
    """prt_fill_matrix: samples x genes; the group's value unless the sample has an own prediction."""
    samples = preds.select("sample_id", "perturbation").distinct()
    grid = samples.join(grouped.select("perturbation", "gene", F.col("predicted").alias("_g")), "perturbation")
    own = preds.select("sample_id", "gene", F.col("predicted").alias("_o"))
    return grid.join(own, ["sample_id", "gene"], "left").select("sample_id", "perturbation", "gene", F.coalesce("_o", "_g").alias("value"))


# Challenge baselines of the three scores.
BASE_MAE, BASE_PDS, BASE_DES = 0.028, 0.5116, 0.0


def scaled_scores(df, mae="mae", des="des", pds="pds") -> DataFrame:
    """prt_scaled_score: scores relative to the baseline, clipped at zero, and their mean x 100."""
    def pos(c: Column):
        return F.greatest(F.lit(0.0), c)

    out = df.withColumns({
        "scaled_mae": pos((BASE_MAE - F.col(mae)) / BASE_MAE),
        "scaled_des": pos((F.col(des) - BASE_DES) / (1 - BASE_DES)),
        "scaled_pds": pos((F.col(pds) - BASE_PDS) / (1 - BASE_PDS)),
    })
    return out.withColumn("final_score", (F.col("scaled_mae") + F.col("scaled_pds") + F.col("scaled_des")) / 3 * 100)


def r2_by_key(expr, obs, controls=None) -> DataFrame:
    """prt_r2_by_key: R2 of the mean profile of every key, predicted by its cell type's control mean or by zero.

    Genes without reads count as zeros: they enter through the number of genes only.
    """
    n_genes = expr.select(F.count_distinct("gene")).scalar()
    y = plain_group_means(expr, obs, ["key"]).select("key", "gene", F.col("mean").alias("y"), F.lit(0.0).alias("p"))
    rows = y
    if controls is not None:
        types = obs.select("key").distinct().withColumn("cell_type", F.split("key", "_")[0])
        p = types.join(controls, "cell_type").select("key", "gene", F.lit(0.0).alias("y"), F.col("mean").alias("p"))
        rows = y.unionByName(p).groupBy("key", "gene").agg(F.sum("y").alias("y"), F.sum("p").alias("p"))
    d = F.col("y") - F.col("p")
    s = rows.groupBy("key").agg(F.sum(d * d).alias("sse"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("sy"))
    sst = F.col("yy") - F.col("sy") * F.col("sy") / n_genes
    return s.select("key", F.when(sst > 0, 1 - F.col("sse") / sst).alias("r2"))


def assemble_results(models: dict[str, DataFrame], clamp: bool = False) -> DataFrame:
    """prt_assemble_results: union of model results, key in three parts, dose in micromolar, optional clamp."""
    out = None
    for name, df in models.items():
        one = df.withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    part = F.split("key", "_")
    return out.select(
        "model", F.col("key").alias("combination"), part[0].alias("cell_line"), part[1].alias("drug"),
        (part[2].cast("double") * 10).alias("dose"), (F.when(F.col("r2").isNotNull(), F.greatest("r2", F.lit(0.0))) if clamp else F.col("r2")).alias("r2"))


def r2_summary(results) -> DataFrame:
    """prt_r2_summary: median, mean and clamped mean per model and dose, four decimals."""
    out = results.groupBy("model", "dose").agg(
        F.median("r2").alias("median"), F.avg("r2").alias("mean"), F.avg(F.when(F.col("r2").isNotNull(), F.greatest("r2", F.lit(0.0)))).alias("mean_clamped"))
    return out.select("model", "dose", *[F.round(c, 4).alias(c) for c in ("median", "mean", "mean_clamped")])



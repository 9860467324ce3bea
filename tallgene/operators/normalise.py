"""Normalisation, transformation and binning of matrix values (survey section 2.4).

Implicit zeros: scaling, logs and bins leave them zero; operators that can change a zero say so.
Windows by cell are bounded by the number of genes.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.lists import beside
from tallgene.functions.rand import hash_uniform
from tallgene.functions.ranks import global_quantiles, quantiles

def by_cell():
    return Window.partitionBy("cell_id")


def normalize_total(expr, target_sum=None, exclude_highly_expressed=False, max_fraction=0.05) -> DataFrame:
    """nrm_total: scale every cell to ``target_sum`` (None = median of the cell totals)."""
    counted = expr
    if exclude_highly_expressed:
        share = expr.withColumn("_s", F.col("value") / F.sum("value").over(by_cell()))
        dominant = share.where(F.col("_s") > max_fraction).select("gene").distinct()
        flagged = expr.join(dominant.withColumn("_hi", F.lit(True)), "gene", "left")
        counted = flagged.withColumn("_c", F.when(F.col("_hi"), F.lit(0.0)).otherwise(F.col("value"))).drop("_hi")
    else:
        counted = expr.withColumn("_c", F.col("value"))
    if target_sum is None:
        totals = counted.groupBy("cell_id").agg(F.sum("_c").alias("_t")).where(F.col("_t") > 0)
        target = global_quantiles(totals, "_t", {"median": 0.5})["median"]
    else:
        target = F.lit(float(target_sum))
    total = F.sum("_c").over(by_cell())
    return counted.withColumn("_t", total).select(
        "cell_id", "gene",
        F.when(F.col("_t") == 0, F.col("value")).otherwise(F.col("value") / F.col("_t") * target).alias("value"),
    )


def scale_counts(expr, factor: float) -> DataFrame:
    """nrm_scale."""
    return expr.withColumn("value", F.col("value") * F.lit(factor))


def log_transform(expr, base: float | None = None, add_one: bool = True) -> DataFrame:
    """nrm_log: log(1+x) in a base; without ``add_one`` about ln x, clipped at zero."""
    out = F.log1p("value") if add_one else F.greatest(F.lit(0.0), F.log1p(F.col("value") - F.lit(0.999999)))
    return expr.withColumn("value", out / F.lit(math.log(base)) if base else out)


def median_normalize(expr, medians) -> DataFrame:
    """nrm_median: divide by the gene's median; a gene without median is an error."""
    joined = expr.join(medians.select("gene", "median"), "gene", "left")
    value = F.when(F.col("median").isNull(), F.raise_error(F.concat(F.lit("no median for gene "), "gene"))).otherwise(
        F.col("value") / F.col("median")
    )
    return joined.select("cell_id", "gene", value.alias("value"))


def median_normalize_sample(expr, medians) -> DataFrame:
    """nrm_median_sample: divide by the gene's median; genes without one are dropped."""
    return expr.join(medians.select("gene", "median"), "gene").select(
        "cell_id", "gene", (F.col("value") / F.col("median")).alias("value")
    )


def log_normalize_sample(expr, normalized_sum: float = 10000.0) -> DataFrame:
    """nrm_log_sample: log1p(x / (sum + 1) * s); the +1 is part of the definition."""
    return expr.withColumn(
        "value", F.log1p(F.col("value") / (F.sum("value").over(by_cell()) + 1) * F.lit(float(normalized_sum)))
    )


def exon_lengths(exons) -> DataFrame:
    """Length in kb of the union of a gene's exon intervals [start, end)."""
    w = Window.partitionBy("gene").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    seen = exons.select("gene", "start", "end").distinct().withColumn("_to", F.max("end").over(w))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce("_to", F.col("start"))))
    return seen.groupBy("gene").agg((F.sum(fresh) / 1000.0).alias("length_kb"))


def tpm(expr, lengths, min_value=None, min_share=None) -> DataFrame:
    """nrm_tpm: length-scaled rates summing to 1e6 per cell; optional filter on genes seen in enough cells."""
    nonzero = expr.where(F.col("value") != 0)
    rates = nonzero.join(lengths, "gene").withColumn("_r", F.col("value") / F.col("length_kb"))
    out = rates.select("cell_id", "gene", (F.col("_r") / F.sum("_r").over(by_cell()) * 1e6).alias("value"))
    if min_value is None:
        return out
    n_cells = nonzero.select(F.count_distinct("cell_id")).scalar()
    keep = out.groupBy("gene").agg(F.count_if(F.col("value") > min_value).alias("_n"))
    return out.join(keep.where(F.col("_n") >= F.lit(min_share) * n_cells), "gene", "left_semi")


def bin_int_cast(expr, num_bins: int | None = None) -> DataFrame:
    """nrm_bin_intcast: ceil, clipped to num_bins - 1."""
    up = F.ceil("value")
    return expr.withColumn("value", F.least(up, F.lit(num_bins - 1)) if num_bins else up)


def _edges(count: int):
    return F.array(*[F.lit(i / (count - 1)) for i in range(count)])


def bin_percentile(expr, num_bins: int) -> DataFrame:
    """nrm_bin_percentile: bins between the cell's own quantiles; bin = edges <= value, clipped to 1..n."""
    edges = F.percentile("value", _edges(num_bins + 1)).over(by_cell())
    rank = F.size(F.filter("_e", lambda e: e <= F.col("value")))
    return expr.withColumn("_e", edges).withColumn(
        "value", F.least(F.greatest(rank, F.lit(1)), F.lit(num_bins)).cast("bigint")
    ).drop("_e")


def bin_value(expr, num_bins: int, seed=0) -> DataFrame:
    """nrm_bin_value: as above with num_bins edges; a value on repeated edges draws a bin between both sides."""
    edges = F.percentile("value", _edges(num_bins)).over(by_cell())
    left = F.size(F.filter("_e", lambda e: e <= F.col("value")))
    right = F.size(F.filter("_e", lambda e: e < F.col("value")))
    draw = hash_uniform(seed, "cell_id", "gene")
    return expr.withColumn("_e", edges).withColumn("value", F.ceil(draw * (right - left) + left)).drop("_e")


def guess_raw(expr, is_integer_type: bool, threshold: int = 4) -> DataFrame:
    """nrm_guess_raw: six-rule score on all values; raw when the score reaches the threshold."""
    v = F.col("value")
    one = expr.agg(
        F.max(v).alias("mx"), F.avg(v).alias("mean"),
        F.avg((v == 1).cast("double")).alias("ones"), F.avg(v.isin(1.0, 2.0, 3.0).cast("double")).alias("small"),
    )
    rules = [F.lit(bool(is_integer_type)), F.col("mx") > 50, F.col("ones") > 0.4, F.col("mean") < 2.5,
             global_quantiles(expr, "value", {"med": 0.5})["med"] <= 1, F.col("small") > 0.6]
    score = sum((x.cast("int") for x in rules[1:]), rules[0].cast("int"))
    return one.select(score.alias("score"), (score >= threshold).alias("is_raw"))


def downcast(expr, how: str = "round") -> DataFrame:
    """nrm_downcast: to integers; round goes half to even."""
    fn = {"round": lambda c: F.bround(c, 0), "floor": F.floor, "ceil": F.ceil}[how]
    return expr.withColumn("value", fn(F.col("value")).cast("bigint"))


def gene_moments(expr, cells) -> DataFrame:
    """Mean and sample deviation per gene over all cells; zeros count through the number of cells."""
    n = cells.select(F.count("*")).scalar()
    v = F.col("value")
    sums = expr.groupBy("gene").agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    mean = F.col("s") / n
    var = F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1))
    return sums.select("gene", mean.alias("mean"), var.alias("variance"))


def zscore(expr, cells, genes, max_value: float = 10.0) -> DataFrame:
    """nrm_zscore: dense z-scores on a gene list (HVG), clipped above."""
    from tallgene.operators.filters import dense_rows

    listed = expr.join(genes.select("gene"), "gene", "left_semi")
    m = gene_moments(listed, cells)
    sd = F.sqrt("variance")
    z = (F.col("value") - F.coalesce("mean", F.lit(0.0))) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(sd)
    return dense_rows(listed, cells, genes).join(m, "gene", "left").select(
        "cell_id", "gene", F.least(z, F.lit(max_value)).alias("value")
    )


def fill_genes(cells, gene_values) -> DataFrame:
    """Every cell next to every (gene, value) of a gene list."""
    return beside(cells.select("cell_id"), gene_values, "gene", "value")


def perturb_extreme(expr, cells, changes) -> DataFrame:
    """nrm_perturb_extreme: listed genes take their max ("positive") or min ("negative", zeros count) in all cells."""
    n = cells.select(F.count("*")).scalar()
    ext = expr.join(changes, "gene").groupBy("gene", "direction").agg(
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("*").alias("c")
    )
    low = F.when(F.col("c") < n, F.least(F.col("lo"), F.lit(0.0))).otherwise(F.col("lo"))
    high = F.when(F.col("c") < n, F.greatest(F.col("hi"), F.lit(0.0))).otherwise(F.col("hi"))
    new = ext.select("gene", F.when(F.col("direction") == "positive", high).otherwise(low).alias("value"))
    rest = expr.join(changes.select("gene"), "gene", "left_anti").select("cell_id", "gene", "value")
    return rest.unionByName(fill_genes(cells, new.where(F.col("value") != 0)))


def perturb_expression(expr, rules: dict[str, str]) -> DataFrame:
    """nrm_perturb_expr: replace values of listed genes by an arithmetic rule over MAX and flag them."""
    for rule in rules.values():
        if not re.fullmatch(r"(MAX|[0-9.]+|[-+*/() ])+", rule):
            raise ValueError(f"not allowed in a perturbation rule: {rule}")
    hit = F.col("gene").isin(*rules)
    tops = expr.where(hit).groupBy("gene").agg(F.max("value").alias("MAX"))
    value = F.col("value")
    for g, rule in rules.items():
        value = F.when(F.col("gene") == g, F.expr(rule).cast("double")).otherwise(value)
    return expr.join(tops, "gene", "left").select(
        "cell_id", "gene", value.alias("value"), hit.cast("int").alias("perturbed")
    )


def replace_noise_with_baseline(expr, cells, baseline, threshold: float = 0.1, absolute: bool = True) -> DataFrame:
    """nrm_baseline_replace: values close to the gene's baseline become the baseline.

    A zero entry can only change when |baseline| itself is under the threshold, so just those genes are filled.
    """
    b = F.col("baseline")
    joined = expr.join(baseline, "gene")
    diff = F.abs(F.col("value") - b)
    if absolute:
        near, zero_near = diff < threshold, F.abs(b) < threshold
    else:
        base = F.when(b == 0, F.lit(0.01)).otherwise(b)
        signed = F.when((b == 0) & (F.col("value") - b < 0), F.lit(0.0)).otherwise(F.col("value") - b)
        near, zero_near = F.abs(signed) / base < threshold, F.lit(threshold > 1)
    changed = joined.select("cell_id", "gene", F.when(near, b).otherwise(F.col("value")).alias("value"))
    fill = baseline.where(zero_near & (b != 0)).select("gene", b.alias("value"))
    zeros = fill_genes(cells, fill).join(expr.select("cell_id", "gene"), ["cell_id", "gene"], "left_anti")
    return changed.where(F.col("value") != 0).unionByName(zeros)


def cap_at_quantile(expr, q: float = 0.9) -> DataFrame:
    """nrm_cap_quantile: cap each gene at the quantile of its nonzero values."""
    caps = quantiles(expr.where(F.col("value") > 0), ["gene"], "value", {"cap": q})
    return expr.join(caps, "gene").select("cell_id", "gene", F.least("value", "cap").alias("value"))


def replace_non_hvg(expr, cells, gene_stats, q: float) -> DataFrame:
    """nrm_nonhvg_baseline: genes with dispersion under the (1-q) quantile take their baseline in every cell."""
    cut = global_quantiles(gene_stats, "dispersion", {"c": 1 - q})["c"]
    flat = gene_stats.where(F.col("dispersion") < cut)
    kept = expr.join(flat.select("gene"), "gene", "left_anti").select("cell_id", "gene", "value")
    base = flat.where(F.col("baseline") != 0).select("gene", F.col("baseline").alias("value"))
    return kept.unionByName(fill_genes(cells, base))

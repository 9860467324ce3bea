"""Aggregations and statistics (survey section 2.5).

Means, variances and tests count implicit zeros through the number of cells; medians and
quantile caps look at nonzero entries only.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.gram import covariance
from tallgene.functions.lineage import stable
from tallgene.functions.lists import beside
from tallgene.functions.ranks import quantiles
from tallgene.functions.tdist import t_quantile_975
from tallgene.operators.variable_genes import residual_variance, standardized_variance, top_by_variance

CONTROL = "Control"
AVERAGE = "Average_Perturbation_Train"


def qc_cells(expr, var) -> DataFrame:
    """agg_qc_cells: totals, genes seen, mito counts and percentage per cell."""
    v, nz = F.col("value"), F.col("value") != 0
    joined = expr.join(var.select("gene", "mito"), "gene")
    return joined.groupBy("cell_id").agg(
        F.sum(v).alias("total_counts"), F.count_if(nz).alias("n_genes_by_counts"),
        F.sum(F.when(F.col("mito"), v).otherwise(F.lit(0.0))).alias("total_counts_mt"),
    ).withColumn("pct_counts_mt", F.when(F.col("total_counts") != 0, 100.0 * F.col("total_counts_mt") / F.col("total_counts")))


def qc_genes(expr, cells) -> DataFrame:
    """agg_qc_genes: cells per gene, mean over all cells, dropout percentage, total."""
    n = cells.select(F.count("*")).scalar()
    out = expr.groupBy("gene").agg(F.count_if(F.col("value") != 0).alias("n_cells_by_counts"), F.sum("value").alias("total_counts"))
    return out.withColumns({
        "mean_counts": F.col("total_counts") / n,
        "pct_dropout_by_counts": 100.0 * (1 - F.col("n_cells_by_counts") / n),
    })


def qc_removed_report(cell_stats, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """agg_qc_removed_report: rows under and over each limit, and the union of removals."""
    aggs, any_bad = [F.count("*").alias("n_cells")], F.lit(False)
    for c, (low, high) in limits.items():
        under, over = F.col(c) < low, F.col(c) > high
        aggs += [F.count_if(under).alias(f"{c}_under"), F.count_if(over).alias(f"{c}_over")]
        any_bad = any_bad | under | over
    aggs.append(F.count_if(any_bad).alias("n_removed"))
    return cell_stats.agg(*aggs).withColumn("pct_removed", 100.0 * F.col("n_removed") / F.col("n_cells"))


def percentile_lines(df, col: str) -> DataFrame:
    """agg_percentile_lines: quartiles and median -/+ 1.5 IQR."""
    q = quantiles(df, [], col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"low": F.col("median") - 1.5 * iqr, "high": F.col("median") + 1.5 * iqr})


def histogram(df, col: str, bins: int, log: bool = False) -> DataFrame:
    """agg_histogram: equal bins over the range (optionally of log10), last bin closed, with running share."""
    x = df.select((F.log10(col) if log else F.col(col).cast("double")).alias("x")).where(F.col("x").isNotNull())
    lo, hi = x.select(F.min("x")).scalar(), x.select(F.max("x")).scalar()
    width = (hi - lo) / F.lit(bins)
    bin_ = F.when(hi > lo, F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = x.select(bin_.cast("bigint").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("bin", (lo + width * F.col("bin")).alias("left_edge"), "n", (run / total).alias("cumulative"))


def gene_median(expr) -> DataFrame:
    """agg_gene_median: exact median over nonzero entries per gene."""
    return quantiles(expr.where(F.col("value") != 0), ["gene"], "value", {"median": 0.5})


def gene_quantiles(expr) -> DataFrame:
    """agg_gene_quantiles: 50 / 75 / 90 percent over nonzero entries."""
    return quantiles(expr.where(F.col("value") != 0), ["gene"], "value", {"q50": 0.5, "q75": 0.75, "q90": 0.9})


def gene_max(expr) -> DataFrame:
    """agg_max: largest value per gene (a gene seen in no cell has none)."""
    return expr.groupBy("gene").agg(F.max("value").alias("value"))


def max_expression(expr) -> DataFrame:
    return expr.agg(F.max("value").alias("value"))


def max_counts(expr, max_length: int) -> DataFrame:
    """Largest sum of the top ``max_length`` values of a cell."""
    w = Window.partitionBy("cell_id").orderBy(F.col("value").desc(), "gene")
    top = expr.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_length)
    return top.groupBy("cell_id").agg(F.sum("value").alias("value")).agg(F.max("value").alias("value"))


def group_sizes(obs, group) -> DataFrame:
    return obs.groupBy(*group).agg(F.count("*").alias("n_cells"))


def group_sums(expr, obs, group, value: Column | None = None, *more: Column) -> DataFrame:
    """Sums by (group, gene) and group sizes; hot groups shrink before the shuffle."""
    value = F.col("value") if value is None else value
    joined = expr.join(obs.select("cell_id", *group), "cell_id")
    sums = joined.groupBy(*group, "gene").agg(F.sum(value).alias("s"), *more)
    return sums.join(group_sizes(obs, group), list(group))


def plain_group_means(expr, obs, group, exp_before_mean: bool = False) -> DataFrame:
    """Mean per (group, gene), zeros counted; optional log1p(mean(expm1(x)))."""
    sums = group_sums(expr, obs, group, F.expm1("value") if exp_before_mean else F.col("value"))
    mean = F.col("s") / F.col("n_cells")
    return sums.select(*group, "gene", (F.log1p(mean) if exp_before_mean else mean).alias("mean"))


def group_means(expr, obs, exp_before_mean: bool = False, split: str = "train", col: str = "perturbation") -> DataFrame:
    """agg_group_means: pseudobulk per perturbation, plus the unweighted mean over train perturbations.

    Group means absent from the sparse result are zero and count in the average row.
    """
    means = stable(plain_group_means(expr, obs, [col], exp_before_mean))
    train = obs.where((F.col("split") == split) & (F.col(col) != CONTROL)).select(col).distinct()
    n_train = train.select(F.count("*")).scalar()
    average = means.join(train, col, "left_semi").groupBy("gene").agg((F.sum("mean") / n_train).alias("mean"))
    return means.unionByName(average.select(F.lit(AVERAGE).alias(col), "gene", "mean"))


def fileset_means(files: dict[str, tuple[DataFrame, DataFrame]], exp_before_mean: bool = False) -> DataFrame:
    """agg_fileset_means: union of (expr, obs) per split; controls only from the first file, with null split."""
    exprs, cells = None, None
    for i, (split, (expr, obs)) in enumerate(files.items()):
        keep = obs if i == 0 else obs.where(F.col("perturbation") != CONTROL)
        keep = keep.select("cell_id", "perturbation",
                           F.when(F.col("perturbation") != CONTROL, F.lit(split)).alias("split"))
        part = expr.join(keep.select("cell_id"), "cell_id", "left_semi")
        exprs = part if exprs is None else exprs.unionByName(part)
        cells = keep if cells is None else cells.unionByName(keep)
    return group_means(exprs, cells, exp_before_mean)


def control_means(expr, obs) -> DataFrame:
    """agg_control_means: mean expression of control cells per cell type."""
    return plain_group_means(expr, obs.where(F.col("perturbation") == CONTROL), ["cell_type"])


def group_means_by_key(expr, obs) -> DataFrame:
    """agg_group_means_by_key: means per cell_drug_dose key in each split, key in three parts, dose x 10000."""
    drugs = obs.groupBy("product_name").agg(F.min_by("smiles", "cell_id").alias("smiles"))
    means = plain_group_means(expr, obs, ["split", "key"])
    part = F.split("key", "_")
    return means.withColumns({
        "cell_type": part[0], "product_name": part[1], "dose": part[2].cast("double") * 10000,
    }).join(drugs, "product_name", "left")


# highly variable genes ------------------------------------------------------------------------

def gene_dispersion(expr, obs, flavor: str, batch: list[str]) -> DataFrame:
    """Mean, variance and dispersion per gene (and batch) from one aggregate; zeros counted."""
    x = F.expm1("value") if flavor == "seurat" else F.col("value")
    sums = group_sums(expr, obs, batch, x, F.sum(x * x).alias("ss")) if batch else (
        expr.groupBy("gene").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
        .withColumn("n_cells", obs.select(F.count("*")).scalar())
    )
    n = F.col("n_cells")
    mean = F.col("s") / n
    var = F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * mean) / (n - 1))
    base = sums.select(*batch, "gene", mean.alias("mean"), var.alias("variance")).where("mean > 0")
    disp = F.col("variance") / F.col("mean")
    if flavor == "seurat":
        return base.withColumns({
            "dispersion": F.when(disp > 0, F.ln(disp)), "mean": F.log1p("mean"),
        })
    return base.withColumn("dispersion", disp)


def highly_variable_genes(expr, obs, flavor="seurat", n_top_genes=None, n_bins=20, min_disp=0.5, max_disp=None,
                          min_mean=0.0125, max_mean=3.0, batch_key=None, span=0.3, theta=100.0, clip=None) -> DataFrame:
    """agg_hvg: dispersion normalised inside bins of the mean; top n or cut-offs; batches combined.

    ``seurat_v3`` and ``pearson_residuals`` take raw counts and need ``n_top_genes``, see :mod:`tallgene.operators.variable_genes`.
    The gene table is small (one row per gene and batch), so windows over it are bounded by the genome.
    """
    batch = [batch_key] if batch_key else []
    if flavor in ("seurat_v3", "pearson_residuals"):
        if n_top_genes is None:
            raise ValueError(f"flavor {flavor} needs n_top_genes")
        scored = standardized_variance(expr, obs, batch, span) if flavor == "seurat_v3" else residual_variance(expr, obs, batch, theta, clip)
        return top_by_variance(scored, batch, n_top_genes, batches_first=flavor == "pearson_residuals")
    g = gene_dispersion(expr, obs, flavor, batch)
    every = Window.partitionBy(*batch)
    if flavor == "seurat":
        lo, hi = F.min("mean").over(every), F.max("mean").over(every)
        g = g.withColumns({"_lo": lo, "_hi": hi})
        width = (F.col("_hi") - F.col("_lo")) / n_bins
        # bins are closed on the right, and the lowest value falls in the first bin
        bin_ = F.greatest(F.lit(1), F.ceil((F.col("mean") - F.col("_lo")) / width))
        g = g.withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), F.least(bin_, F.lit(n_bins))).otherwise(1).cast("int"))
        w = Window.partitionBy(*batch, "bin")
        avg, sd = F.avg("dispersion").over(w), F.stddev_samp("dispersion").over(w)
        alone = F.count("dispersion").over(w) == 1
        norm = F.when(alone, F.lit(1.0)).otherwise((F.col("dispersion") - avg) / F.when(sd != 0, sd))
        g = g.withColumn("dispersion_norm", norm)
    elif flavor == "cell_ranger":
        edges = F.percentile("mean", F.array(*[F.lit(p / 100) for p in range(10, 105, 5)])).over(every)
        g = g.withColumn("_e", edges).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col("mean"))))
        w = Window.partitionBy(*batch, "bin")
        g = g.withColumn("_med", F.percentile("dispersion", F.lit(0.5)).over(w))
        g = g.withColumn("_dev", F.abs(F.col("dispersion") - F.col("_med")))
        mad = F.percentile("_dev", F.lit(0.5)).over(w) / F.lit(0.6744897501960817)
        g = g.withColumn("_mad", mad).withColumn(
            "dispersion_norm", (F.col("dispersion") - F.col("_med")) / F.when(F.col("_mad") != 0, F.col("_mad"))
        )
    else:
        raise ValueError(f"unknown flavor {flavor}")
    g = g.select(*batch, "gene", "mean", "dispersion", "bin", "dispersion_norm")

    def mark(df, part):
        if n_top_genes is not None:
            order = Window.partitionBy(*part).orderBy(F.col("dispersion_norm").desc_nulls_last(), "gene")
            return df.withColumn("highly_variable", F.row_number().over(order) <= n_top_genes)
        ok = (F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (F.col("dispersion_norm") > min_disp)
        if max_disp is not None:
            ok = ok & (F.col("dispersion_norm") < max_disp)
        return df.withColumn("highly_variable", F.coalesce(ok, F.lit(False)))

    g = mark(g, batch)
    if not batch:
        return g
    n_batches = obs.select(F.count_distinct(batch_key)).scalar()
    merged = g.groupBy("gene").agg(
        F.avg("mean").alias("mean"), F.avg("dispersion").alias("dispersion"),
        F.avg("dispersion_norm").alias("dispersion_norm"),
        F.count_if("highly_variable").alias("n_batches_variable"),
    ).withColumn("in_all_batches", F.col("n_batches_variable") == n_batches)
    if n_top_genes is None:
        return mark(merged, [])
    order = Window.orderBy(F.col("n_batches_variable").desc(), F.col("dispersion_norm").desc_nulls_last(), "gene")
    return merged.withColumn("highly_variable", F.row_number().over(order) <= n_top_genes)


# differential expression ----------------------------------------------------------------------

def de_scores(expr, obs, col: str = "perturbation") -> DataFrame:
    """Welch t of every perturbation against the controls, zeros counted."""
    v = F.col("value")
    sums = stable(group_sums(expr, obs, [col], v, F.sum(v * v).alias("ss")))
    sizes = stable(group_sizes(obs, [col]))
    ctrl = sums.where(F.col(col) == CONTROL).select("gene", F.col("s").alias("cs"), F.col("ss").alias("css"))
    n_ctrl = sizes.where(F.col(col) == CONTROL).select(F.max("n_cells")).scalar()
    grid = beside(sizes.where(F.col(col) != CONTROL).select(col, "n_cells"), sums, "gene", distinct=True)
    full = grid.join(sums.select(col, "gene", "s", "ss"), [col, "gene"], "left").join(ctrl, "gene", "left").fillna(0.0)

    def moments(s, ss, n):
        m = s / n
        return m, F.greatest(F.lit(0.0), (ss - s * m) / (n - 1))

    m1, v1 = moments(F.col("s"), F.col("ss"), F.col("n_cells"))
    m0, v0 = moments(F.col("cs"), F.col("css"), n_ctrl)
    se = F.sqrt(v1 / F.col("n_cells") + v0 / n_ctrl)
    return full.where(F.col("n_cells") > 1).select(
        col, "gene", m1.alias("mean"), m0.alias("control_mean"),
        F.when(se > 0, (m1 - m0) / se).otherwise(F.lit(0.0)).alias("score"),
    )


def de_rank(scores, n_genes: int = 50, col: str = "perturbation", digits: int = 9) -> DataFrame:
    """agg_de_rank: genes by absolute score per perturbation, first ``n_genes`` (bounded by the gene list)."""
    w = Window.partitionBy(col).orderBy(F.round(F.abs("score"), digits).desc(), "gene")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_genes)


def de_nonzero_nondropout(ranked, top: int = 20, col: str = "perturbation") -> DataFrame:
    """agg_de_nonzero_nondropout: first genes with a non-zero mean; and those non-zero or zero in control too."""
    non_zero = F.col("mean") != 0
    kinds = F.array(
        F.when(non_zero, F.lit("non_zero")),
        F.when(non_zero | (F.col("control_mean") == 0), F.lit("non_dropout")),
    )
    rows = ranked.withColumn("kind", F.explode(F.array_compact(kinds)))
    w = Window.partitionBy(col, "kind").orderBy("rank")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top).select(col, "kind", "pos", "gene")


# tables -----------------------------------------------------------------------------------------

def crosstab_sorted(obs, row: str, col: str) -> DataFrame:
    """agg_crosstab: counts with zeros filled; rows and columns ranked by their number of non-empty cells."""
    n = obs.groupBy(row, col).agg(F.count("*").alias("n"))
    rows = n.groupBy(row).agg(F.count("*").alias("row_filled"))
    cols = n.groupBy(col).agg(F.count("*").alias("col_filled"))
    rows = rows.withColumn("row_rank", F.row_number().over(Window.orderBy(F.col("row_filled").desc(), row)))
    cols = cols.withColumn("col_rank", F.row_number().over(Window.orderBy(F.col("col_filled").desc(), col)))
    grid = beside(rows.select(row, "row_rank"), cols, col, "col_rank")
    return grid.join(n, [row, col], "left").fillna(0, subset=["n"])


def crosstab_wide(df, row: str, col: str, values: list | None = None) -> DataFrame:
    """agg_crosstab2: contingency of two columns, one output column per value, or per listed value."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0)


def split_balance(obs, split="split", label="cell_type", dataset="dataset") -> DataFrame:
    """agg_split_balance: cells and datasets per split and cell type (distinct datasets counted in two steps)."""
    per = obs.groupBy(split, label, dataset).agg(F.count("*").alias("n"))
    return per.groupBy(split, label).agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_datasets"))


def distinct_profile(df, cols: list[str]) -> DataFrame:
    """agg_distinct_profile: number of distinct values and share of nulls per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]))
    one = df.select(pairs.alias("p")).groupBy("p.column", "p.v").agg(F.count("*").alias("n"))
    return one.groupBy("column").agg(
        F.count("v").alias("n_distinct"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum("n").alias("n_rows"),
    )


def distinct_pairs(df, a: str, b: str) -> DataFrame:
    """Number of distinct ``b`` per ``a``."""
    return df.select(a, b).distinct().groupBy(a).agg(F.count("*").alias("n"))


def feature_correlation(df, features: list[str]) -> DataFrame:
    """agg_feature_corr: correlation of every feature pair from one aggregate, long form."""
    pairs = [(a, b) for a in features for b in features]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    items = F.explode(F.array(*[
        F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs
    ]))
    return one.select(items.alias("i")).select("i.*")


def feature_mutual_information(df, features: list[str], bins: int) -> DataFrame:
    """agg_feature_mi: histogram mutual information over equal-width bins, divided by the larger entropy."""
    binned = df.select(*features).dropna()
    cols = []
    for f in features:
        lo, hi = binned.select(F.min(f)).scalar(), binned.select(F.max(f)).scalar()
        cols.append(F.least(F.floor((F.col(f) - lo) / (hi - lo) * bins), F.lit(bins - 1)).alias(f))
    binned = binned.select(*cols)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(a).alias("x"), F.col(b).alias("y"))
        for a, b in combinations(features, 2)
    ]))
    joint = binned.select(pairs.alias("p")).select("p.*").groupBy("f1", "f2", "x", "y").agg(F.count("*").alias("c"))
    pair, px, py = Window.partitionBy("f1", "f2"), Window.partitionBy("f1", "f2", "x"), Window.partitionBy("f1", "f2", "y")
    j = joint.withColumns({"n": F.sum("c").over(pair), "cx": F.sum("c").over(px), "cy": F.sum("c").over(py)})
    p = F.col("c") / F.col("n")
    out = j.groupBy("f1", "f2").agg(
        F.sum(p * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"),
        F.sum(-p * F.ln(F.col("cx") / F.col("n"))).alias("hx"), F.sum(-p * F.ln(F.col("cy") / F.col("n"))).alias("hy"),
    )
    top = F.greatest("hx", "hy")
    return out.select("f1", "f2", "mi", F.when(top > 0, F.col("mi") / top).otherwise(0.0).alias("nmi"))


def perturbation_distance(means, col: str = "perturbation") -> DataFrame:
    """agg_pert_distance: 1 - correlation of a perturbation's mean profile with the control profile over all genes.

    Absent genes are zeros: they add to the number of genes and to no sum, so profiles are never filled.
    """
    means = stable(means)
    ctrl = means.where(F.col(col) == CONTROL).select("gene", F.col("mean").alias("c"))
    n = means.select(F.count_distinct("gene").cast("double")).scalar()
    x, c = F.col("mean"), F.coalesce("c", F.lit(0.0))
    sums = means.where(F.col(col) != CONTROL).join(ctrl, "gene", "left").groupBy(col).agg(
        F.sum(x).alias("x"), F.sum(x * x).alias("xx"), F.sum(x * c).alias("xc"))
    of_c = stable(ctrl.agg(F.struct(F.coalesce(F.sum("c"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0)).alias("ss")).alias("c"))).scalar()
    spread = (n * F.col("xx") - F.col("x") * F.col("x")) * (n * of_c["ss"] - of_c["s"] * of_c["s"])
    return sums.select(col, F.when(spread > 0, 1 - (n * F.col("xc") - F.col("x") * of_c["s"]) / F.sqrt(spread)).alias("distance"))


def elastic_net(cov: np.ndarray, reg: float, l1_ratio: float) -> np.ndarray:
    """Coefficients of standardised features for the label in the last row of a covariance: coordinate descent until nothing moves.

    The loss is half the mean squared error plus reg * (l1_ratio * |b| + (1 - l1_ratio) / 2 * b^2); a constant feature has 0.
    """
    sd = np.sqrt(np.diag(cov)[:-1])
    live = sd > 0
    scale = np.where(live, sd, 1.0)
    g, r, b = cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale, np.zeros(len(sd))
    for _ in range(100_000):
        before = b.copy()
        for j in np.flatnonzero(live):
            pull = r[j] - g[j] @ b + b[j]
            b[j] = np.sign(pull) * max(0.0, abs(pull) - reg * l1_ratio) / (1 + reg * (1 - l1_ratio))
        if np.abs(b - before).max(initial=0) <= 1e-13 * (1 + np.abs(b).max(initial=0)):
            break
    return b


def feature_regression(df, features: list[str], label: str, reg: float = 0.1, l1_ratio: float = 0.5) -> DataFrame:
    """agg_feature_regression: elastic net of a label on standardised features; coefficients as rows, null without complete rows.

    Rows with a null take no part. Spark adds up the covariance of features and label, which tells all that the fit needs.
    """
    vec = F.array(*[F.col(c).cast("double") for c in (*features, label)]).alias("vec")
    _, cov, n = covariance(df.dropna(subset=[*features, label]).select(vec))
    found = elastic_net(cov * (n - 1) / n, reg, l1_ratio).tolist() if n else [None] * len(features)
    return df.sparkSession.createDataFrame(list(zip(features, found, strict=True)), "feature string, coefficient double")


def selection_frequency(coefficients) -> DataFrame:
    """agg_selection_frequency: mean, deviation and share of non-zero coefficients per feature over fits."""
    c = F.col("coefficient")
    return coefficients.groupBy("feature").agg(
        F.avg(c).alias("mean_coef"), F.stddev_samp(c).alias("std_coef"), F.avg((c != 0).cast("double")).alias("nonzero_frac")
    )


def validate_counts(obs, required, col: str = "perturbation") -> DataFrame:
    """agg_validate_counts: cells per perturbation against the required numbers."""
    have = obs.groupBy(col).agg(F.count("*").alias("n_cells"))
    status = (
        F.when(F.col("n_cells").isNull(), "missing").when(F.col("n_required").isNull(), "unexpected")
        .when(F.col("n_cells") != F.col("n_required"), "mismatch").otherwise("ok")
    )
    return have.join(required, col, "full_outer").withColumn("status", status)


def variation_share(df, col: str = "seq") -> DataFrame:
    """agg_variation_pct: share of characters outside ACGTN."""
    other = F.length(F.regexp_replace(col, "[ACGTN]", ""))
    return df.withColumn("variation", F.when(F.length(col) > 0, other / F.length(col)).otherwise(0.0))


def proportion_ci(mean: Column, n: Column, method: str) -> tuple[Column, Column]:
    """Binomial or Wilson 95% bounds of a proportion."""
    z = 1.96
    if method == "binomial":
        half = z * F.sqrt(mean * (1 - mean) / n)
        ok = (mean >= 0) & (mean <= 1)
        return F.when(ok, mean - half), F.when(ok, mean + half)
    if method == "wilson":
        denom = 1 + z * z / n
        center = (mean + z * z / (2 * n)) / denom
        half = z * F.sqrt(mean * (1 - mean) / n + z * z / (4 * n * n)) / denom
        return F.greatest(F.lit(0.0), center - half), F.least(F.lit(1.0), center + half)
    raise ValueError(method)


def bootstrap_ci(runs, by: list[str], col: str = "value", method: str = "bootstrap_quantiles") -> DataFrame:
    """agg_ci over bootstrap runs: 2.5 / 97.5 percent quantiles, or a t interval on the deviation of the runs."""
    if method == "bootstrap_quantiles":
        q = F.percentile(col, F.array(F.lit(0.025), F.lit(0.975)))
        return runs.groupBy(*by).agg(F.avg(col).alias("mean"), q.alias("q")).select(
            *by, "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
    if method == "bootstrap_t_interval":
        half = t_quantile_975(F.col("n") - 1) * F.col("sd")
        return runs.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("sd"), F.count(col).alias("n")).select(
            *by, "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))
    raise ValueError(method)



"""Prediction metrics over long tables (survey section 2.14).

Null is "no label"; ``-100`` is only read or written at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.ranks import value_ranks
from tallgene.functions.tdist import t_two_sided_p
from tallgene.operators.stats import bootstrap_ci, proportion_ci

IGNORE = -100
SILENCED = "Silenced Label Value"


def softmax(logits: Column) -> Column:
    """met_softmax: probabilities of an array of logits."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def field_frame(batches, vocab, samples=None) -> DataFrame:
    """met_field_frame: batches of (sample, gene id, label, predicted) to named rows.

    Batches whose sequence length is not the most common one (ties: the longer) drop out, -100 labels
    drop out, ids become names, sample metadata is joined.
    """
    lengths = batches.groupBy("batch_id", "sample_id").agg(F.count("*").alias("len")).groupBy("batch_id").agg(F.max("len").alias("len"))
    common = lengths.groupBy("len").agg(F.count("*").alias("k")).select(F.max_by("len", F.struct("k", "len"))).scalar()
    kept = batches.join(lengths.where(F.col("len") == common).select("batch_id"), "batch_id", "left_semi")
    named = kept.where(F.col("label") != IGNORE).join(vocab.select(F.col("local_id").alias("gene_id"), F.col("token").alias("gene")), "gene_id", "left")
    out = named.select("sample_id", "gene", "predicted", "label")
    return out if samples is None else out.join(samples, "sample_id", "left")


#: Copies of a class name, of which a row meets one.
COPIES = 256


def label_frame(preds, dictionary) -> DataFrame:
    """met_label_frame: class ids to names; the silent id -100 gets its own name.

    Most rows may have one class, so every name has COPIES copies and a row meets one of them by its hash: no task gets all rows of a class.
    """
    out = preds.withColumn("_copy", F.pmod(F.xxhash64(*preds.columns), F.lit(COPIES)).cast("int"))
    for col in ("predicted", "label"):
        names = dictionary.select(F.col("label_id").alias(f"{col}_id"), F.col("label").alias(f"_{col}"))
        names = names.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        out = out.join(names, [f"{col}_id", "_copy"], "left").withColumn(
            col, F.when(F.col(f"{col}_id") == IGNORE, F.lit(SILENCED)).otherwise(F.col(f"_{col}"))).drop(f"_{col}")
    return out.drop("_copy")


def gene_errors(pred, score: str | None = None) -> DataFrame:
    """met_gene_errors: counts, means, deviations and errors per gene against a null model, zero F1, optional AUC."""
    lab, prd, nz = F.col("label"), F.col("predicted"), F.col("label") > 0
    null = pred.groupBy("gene").agg(F.avg(lab).alias("_m"), F.avg(F.when(nz, lab)).alias("_mnz"))
    j = pred.join(null, "gene")
    err = F.abs(prd - lab)

    def nonzero(c):
        return F.when(nz, c)

    tp, fp = F.count_if((lab == 0) & (prd == 0)), F.count_if((lab != 0) & (prd == 0))
    fn = F.count_if((lab == 0) & (prd != 0))
    out = j.groupBy("gene").agg(
        F.count(lab).alias("gene_freq"), F.count_if(nz).alias("gene_nz_freq"),
        F.avg(nonzero(err)).alias("gene_err_nz"), F.avg(nonzero(F.abs(F.col("_mnz") - lab))).alias("gene_err_nz_null"),
        F.avg(err).alias("gene_err"), F.avg(F.abs(F.col("_m") - lab)).alias("gene_err_null"),
        F.avg(lab).alias("gene_avg_expressions"), F.avg(nonzero(lab)).alias("gene_avg_nz_expressions"),
        F.stddev_samp(lab).alias("gene_std_expressions"), F.stddev_samp(nonzero(lab)).alias("gene_std_nz_expressions"),
        F.avg(prd).alias("gene_predicted_avg_expressions"), F.stddev_samp(prd).alias("gene_predicted_std_expressions"),
        F.avg(nonzero(prd)).alias("gene_predicted_avg_nz_expressions"), F.stddev_samp(nonzero(prd)).alias("gene_predicted_std_nz_expressions"),
        tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"),
    )
    # precision and recall are null without predicted or true zeros; both zero gives a null F1
    f1 = F.when(F.col("_tp") > 0, 2.0 * F.col("_tp") / (2 * F.col("_tp") + F.col("_fp") + F.col("_fn")))
    out = out.withColumn("is_zero_f1", f1).drop("_tp", "_fp", "_fn")
    return out if score is None else out.join(group_auc(pred, "gene", lab == 0, score).withColumnRenamed("auc", "is_zero_roc_auc"), "gene", "left")


GENE_MEANS = [
    "gene_err_nz", "gene_err", "gene_avg_expressions", "gene_avg_nz_expressions", "gene_std_expressions", "gene_std_nz_expressions",
    "gene_predicted_avg_expressions", "gene_predicted_std_expressions", "gene_predicted_avg_nz_expressions",
    "gene_predicted_std_nz_expressions", "is_zero_f1",
]


def gene_summary(errors) -> DataFrame:
    """met_gene_summary: means over genes and the share of genes worse than the null model."""
    def worse(a, b):
        return F.avg(F.coalesce((F.col(a) > F.col(b)).cast("double"), F.lit(0.0)))

    return errors.agg(
        *[F.avg(c).alias(c) for c in GENE_MEANS if c in errors.columns],
        worse("gene_err_nz", "gene_err_nz_null").alias("gene_fraction_worse_than_null_nz"),
        worse("gene_err", "gene_err_null").alias("gene_fraction_worse_than_null"))


def group_auc(df, group: str | None, positive: Column, score: str) -> DataFrame:
    """met_auc: Mann-Whitney AUC per group from average ranks; null when a group has one class."""
    by = [group] if group else []
    ranks = value_ranks(df.withColumn("_pos", positive.cast("int")), by, score, {"p": F.col("_pos")})
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    agg = ranks.groupBy(*by).agg(F.sum(rank * F.col("p")).alias("_r"), F.sum("p").alias("_p"), F.max("n_total").alias("_n"))
    neg = F.col("_n") - F.col("_p")
    auc = F.when((F.col("_p") > 0) & (neg > 0), (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * neg))
    return agg.select(*by, auc.alias("auc"))


def average_precision(df, group: str, positive: Column, score: str) -> DataFrame:
    """Average precision per group: precision at each distinct score, weighted by the recall it adds."""
    ranks = value_ranks(df.withColumn("_pos", positive.cast("int")), [group], score, {"p": F.col("_pos")})
    totals = ranks.groupBy(group).agg(F.sum("p").alias("_tp"))
    at = ranks.join(totals, group)
    hits, shown = F.col("_tp") - F.col("p_before"), F.col("n_total") - F.col("n_before")
    return at.groupBy(group).agg(F.sum(F.when(F.col("_tp") > 0, F.col("p") / F.col("_tp") * hits / shown)).alias("ap"))


def sample_loss(pred, logit: str) -> DataFrame:
    """met_sample_loss: per sample MSE on nonzero labels and zero BCE from logits, with their mean and sum."""
    x, y = F.col(logit), (F.col("label") == 0).cast("double")
    err = F.col("predicted") - F.col("label")
    bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    one = pred.groupBy("sample_id").agg(F.avg(F.when(F.col("label") > 0, err * err)).alias("sample_mse"), F.avg(bce).alias("sample_is_zero_bce"))
    both = F.coalesce("sample_mse", F.lit(0.0)) + F.col("sample_is_zero_bce")
    parts = F.when(F.col("sample_mse").isNull(), 1).otherwise(2)
    return one.withColumns({"sample_mean_loss": both / parts, "sample_sum_loss": both})


def confusion(pred) -> DataFrame:
    """Counts by (label, predicted); rows without a label are ignored."""
    return pred.where(F.col("label").isNotNull()).groupBy("label", "predicted").agg(F.count("*").alias("n"))


def classification(pred) -> DataFrame:
    """met_classification: accuracy, macro precision / recall / F1 and Matthews correlation from the confusion table."""
    cm = confusion(pred)
    sides = F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("t"), F.lit(0).alias("p")),
                              F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t"), F.col("n").alias("p"))))
    per = cm.select(sides.alias("s"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    per = per.groupBy("s.c").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), (F.sum("hit") / 2).alias("h"))
    prec = F.when(F.col("p") > 0, F.col("h") / F.col("p")).otherwise(0.0)
    rec = F.when(F.col("t") > 0, F.col("h") / F.col("t")).otherwise(0.0)
    out = per.agg(
        (F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(prec).alias("precision"), F.avg(rec).alias("recall"),
        F.avg(2 * F.col("h") / (F.col("p") + F.col("t"))).alias("f1"),
        F.sum("h").alias("c"), F.sum("t").cast("double").alias("s"), F.sum(F.col("p") * F.col("t")).alias("pt"),
        F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    s2 = F.col("s") * F.col("s")
    den = F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))
    return out.select("accuracy", "precision", "recall", "f1", F.when(den > 0, (F.col("c") * F.col("s") - F.col("pt")) / den).otherwise(0.0).alias("mcc"))


def class_scores(pred, logits: dict[str, str]) -> DataFrame:
    """One-vs-rest AUC and average precision per class."""
    long = pred.where(F.col("label").isNotNull()).select("label", F.explode(F.array(*[
        F.struct(F.lit(k).alias("class"), F.col(c).alias("score")) for k, c in logits.items()])).alias("x")).select("label", "x.*")
    is_class = F.col("label") == F.col("class")
    return group_auc(long, "class", is_class, "score").join(average_precision(long, "class", is_class, "score"), "class")


def accuracy_by_target(pred, method: str = "wilson") -> DataFrame:
    """met_accuracy_by_target: accuracy per label value with an interval."""
    one = pred.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("count"))
    low, high = proportion_ci(F.col("accuracy"), F.col("count"), method)
    return one.withColumns({"lower": low, "upper": high})


def regression(pred) -> DataFrame:
    """met_regression: MAE, MSE, Pearson and the zero / nonzero confusion counts."""
    lab, prd = F.col("label"), F.col("predicted")
    return pred.where(lab.isNotNull()).agg(
        F.avg(F.abs(prd - lab)).alias("mae"), F.avg((prd - lab) * (prd - lab)).alias("mse"), F.corr(prd, lab).alias("pcc"),
        F.count_if((lab == 0) & (prd == 0)).alias("zero_zero"), F.count_if((lab == 0) & (prd != 0)).alias("zero_nonzero"),
        F.count_if((lab != 0) & (prd == 0)).alias("nonzero_zero"), F.count_if((lab != 0) & (prd != 0)).alias("nonzero_nonzero"))


def density(pred, bins: int) -> DataFrame:
    """met_density: two-dimensional histogram over all rows, equal bins on both ranges."""
    ext = pred.agg(F.struct(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("predicted").alias("p0"), F.max("predicted").alias("p1")).alias("e")).scalar()

    def cell(c, lo, hi):
        return F.least(F.floor((F.col(c) - ext.getField(lo)) / ((ext.getField(hi) - ext.getField(lo)) / F.lit(bins))), F.lit(bins - 1))

    return pred.groupBy(cell("label", "l0", "l1").alias("label_bin"), cell("predicted", "p0", "p1").alias("predicted_bin")).agg(F.count("*").alias("n"))


def top_classes(pred, logits: dict[str, str], n: int) -> DataFrame:
    """met_top_classes: the n classes with the largest logits of every sample."""
    items = F.array(*[F.struct((-F.col(c)).alias("k"), F.lit(name).alias("class"), F.col(c).alias("logit")) for name, c in logits.items()])
    top = F.slice(F.array_sort(items), 1, n)
    return pred.select("sample_id", F.posexplode(top).alias("pos", "x")).select("sample_id", "pos", "x.class", "x.logit")


def masked_accuracy(pred) -> DataFrame:
    """met_masked_accuracy: accuracy over rows with a label."""
    return pred.where(F.col("label") != IGNORE).agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))


def perplexity(pred) -> DataFrame:
    """met_perplexity: exp of the mean negative log likelihood of the true class; null without labels."""
    nll = log_sum_exp(F.col("logits")) - F.element_at("logits", F.col("label_id") + 1)
    return pred.where(F.col("label_id") != IGNORE).agg(F.exp(F.avg(nll)).alias("perplexity"))


def token_value_mse(pred, token_values: list[float | None]) -> DataFrame:
    """met_token_value_mse: squared error of the expected token value; tokens without a value are left out."""
    keep = [i for i, v in enumerate(token_values) if v is not None]
    values = F.array(*[F.lit(float(token_values[i])) for i in keep])
    every = F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in token_values])
    probs = softmax(F.array(*[F.col("logits")[i] for i in keep]))
    guess = F.aggregate(F.zip_with(probs, values, lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)
    err = guess - F.element_at(every, F.col("label_id") + 1)
    return pred.where(F.col("label_id") != IGNORE).agg(F.avg(err * err).alias("token_value_mse"))


def run_summary(runs, method: str = "bootstrap_quantiles") -> DataFrame:
    """met_run_summary: metric values over runs to mean (2 decimals) and interval (3 decimals)."""
    ci = bootstrap_ci(runs, ["metric"], method=method)
    return ci.select("metric", F.round("mean", 2).alias("mean"), F.round("lower", 3).alias("lower"), F.round("upper", 3).alias("upper"))


def mean_attributions(scores, alpha: float = 0.05, least: float = 0.1) -> DataFrame:
    """met_attr_mean: mean attribution per gene, one-sample t test, -log2 p, Bonferroni highlight."""
    one = scores.where(F.col("score").isNotNull()).groupBy("gene").agg(
        F.avg("score").alias("attribution"), F.stddev_samp("score").alias("_sd"), F.count("*").alias("n"))
    one = one.where((F.col("n") > 1) & (F.col("_sd") > 0)).withColumn("t", F.col("attribution") / (F.col("_sd") / F.sqrt("n"))).drop("_sd")
    tested = one.withColumn("p_value", t_two_sided_p(F.col("t"), (F.col("n") - 1).cast("double")))
    genes = F.count("*").over(Window.partitionBy())
    return tested.withColumn("neg_log2_p", F.when(F.col("p_value") > 0, -F.log2("p_value"))).withColumn(
        "highlight", (F.col("p_value") < F.lit(alpha) / genes) & (F.abs("attribution") > least))

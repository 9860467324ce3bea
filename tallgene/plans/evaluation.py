"""Queries for prediction metrics."""

from pyspark.sql import functions as F

from tallgene.operators import metrics as mt
from tallgene.plans.aggregates import BOOT, _boot_runs
from tallgene.plans.bind import views
from tallgene.plans.registry import query, rounded

LOGITS = {"A": "logit_a", "N": "logit_n", "R": "logit_r"}


def with_logits(t):
    flag = F.col("label")
    lid = F.when(F.length("sample_id") % 7 == 0, -100).when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    return t.cpred.withColumns({"logits": F.array("logit_a", "logit_n", "logit_r"), "label_id": lid})


LID = "CASE WHEN length(sample_id) % 7 = 0 THEN -100 WHEN label = 'A' THEN 0 WHEN label = 'N' THEN 1 ELSE 2 END"


@query("met_field_frame", """WITH b AS (SELECT l_orderkey // 4 AS batch_id, l_orderkey AS sample_id, l_partkey AS gene_id, CASE WHEN l_linenumber = 2 THEN -100 ELSE l_quantity END AS label,
    l_extendedprice / 1000 AS predicted FROM lineitem),
  ln AS (SELECT batch_id, max(n) AS len FROM (SELECT batch_id, sample_id, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1),
  c AS (SELECT len FROM ln GROUP BY 1 ORDER BY count(*) DESC, len DESC LIMIT 1)
  SELECT sample_id, p_name AS gene, round(predicted, 6) AS predicted, label, o_orderstatus AS batch FROM b JOIN part ON p_partkey = gene_id
  JOIN orders ON o_orderkey = sample_id WHERE label <> -100 AND batch_id IN (SELECT batch_id FROM ln WHERE len = (SELECT len FROM c))""")
def _(t):
    b = t.lineitem.select(
        F.floor(F.col("l_orderkey") / 4).alias("batch_id"), F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("gene_id"),
        F.when(F.col("l_linenumber") == 2, F.lit(-100.0)).otherwise(F.col("l_quantity")).alias("label"), (F.col("l_extendedprice") / 1000).alias("predicted"))
    vocab = t.part.select(F.col("p_partkey").alias("local_id"), F.col("p_name").alias("token"))
    meta = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("batch"))
    return rounded(mt.field_frame(b, vocab, meta), "predicted")


@query("met_label_frame", views("cpred") + f"""SELECT sample_id, CASE WHEN {LID} = -100 THEN 'Silenced Label Value' ELSE label END AS label, predicted FROM cpred""")
def _(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("label")).distinct().withColumn("label_id", F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 1).otherwise(2))
    p = F.when(F.col("predicted") == "A", 0).when(F.col("predicted") == "N", 1).otherwise(2)
    rows = with_logits(t).select("sample_id", F.col("label_id"), p.alias("predicted_id"))
    return mt.label_frame(rows, d).select("sample_id", "label", "predicted")


ERR_SQL = """, nl AS (SELECT gene, avg(label) AS m, avg(label) FILTER (label > 0) AS mnz FROM pred GROUP BY 1),
  e AS (SELECT gene, count(label) AS gene_freq, count(*) FILTER (label > 0) AS gene_nz_freq, avg(abs(predicted - label)) FILTER (label > 0) AS gene_err_nz,
    avg(abs(mnz - label)) FILTER (label > 0) AS gene_err_nz_null, avg(abs(predicted - label)) AS gene_err, avg(abs(m - label)) AS gene_err_null,
    avg(label) AS gene_avg_expressions, avg(label) FILTER (label > 0) AS gene_avg_nz_expressions, stddev_samp(label) AS gene_std_expressions,
    stddev_samp(label) FILTER (label > 0) AS gene_std_nz_expressions, avg(predicted) AS gene_predicted_avg_expressions, stddev_samp(predicted) AS gene_predicted_std_expressions,
    avg(predicted) FILTER (label > 0) AS gene_predicted_avg_nz_expressions, stddev_samp(predicted) FILTER (label > 0) AS gene_predicted_std_nz_expressions,
    CASE WHEN count(*) FILTER (label = 0 AND predicted = 0) > 0 THEN 2 * count(*) FILTER (label = 0 AND predicted = 0)
      / (count(*) FILTER (label = 0) + count(*) FILTER (predicted = 0)) END AS is_zero_f1 FROM pred JOIN nl USING (gene) GROUP BY 1),
  rk AS (SELECT gene, label, rank() OVER (PARTITION BY gene ORDER BY logit_zero) + (count(*) OVER (PARTITION BY gene, logit_zero) - 1) / 2 AS r FROM pred),
  auc AS (SELECT gene, CASE WHEN count(*) FILTER (label = 0) > 0 AND count(*) FILTER (label <> 0) > 0 THEN (sum(r) FILTER (label = 0) - count(*) FILTER (label = 0) * (count(*) FILTER (label = 0) + 1) / 2)
    / (count(*) FILTER (label = 0) * count(*) FILTER (label <> 0)) END AS auc FROM rk GROUP BY 1)"""
ERRS = ["gene_err_nz", "gene_err_nz_null", "gene_err", "gene_err_null", *[m for m in mt.GENE_MEANS if m not in ("gene_err_nz", "gene_err")]]


@query("met_gene_errors", views("pred") + ERR_SQL + f"SELECT gene, gene_freq, gene_nz_freq, {', '.join(f'round({c}, 6) AS {c}' for c in ERRS)}, round(auc, 6) AS is_zero_roc_auc FROM e JOIN auc USING (gene)")
def _(t):
    return rounded(mt.gene_errors(t.pred, "logit_zero"), *ERRS, "is_zero_roc_auc")


@query("met_gene_summary", views("pred") + ERR_SQL + f"""SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in mt.GENE_MEANS)},
  round(avg((gene_err_nz > gene_err_nz_null)::INT), 6) AS gene_fraction_worse_than_null_nz, round(avg((gene_err > gene_err_null)::INT), 6) AS gene_fraction_worse_than_null FROM e""")
def _(t):
    out = mt.gene_summary(mt.gene_errors(t.pred))
    return rounded(out, *out.columns)


@query("met_auc", views("pred") + ERR_SQL + "SELECT gene, round(auc, 6) AS auc FROM auc")
def _(t):
    return rounded(mt.group_auc(t.pred, "gene", F.col("label") == 0, "logit_zero"), "auc")


@query("met_sample_loss", views("pred") + """, s AS (SELECT split_part(sample_id, '-', 1) AS sample_id, avg((predicted - label) * (predicted - label)) FILTER (label > 0) AS a,
    avg(greatest(logit_zero, 0) - logit_zero * (label = 0)::INT + ln(1 + exp(-abs(logit_zero)))) AS b FROM pred GROUP BY 1)
  SELECT sample_id, round(a, 6) AS sample_mse, round(b, 6) AS sample_is_zero_bce, round((coalesce(a, 0) + b) / CASE WHEN a IS NULL THEN 1 ELSE 2 END, 6) AS sample_mean_loss,
    round(coalesce(a, 0) + b, 6) AS sample_sum_loss FROM s""")
def _(t):
    p = t.pred.withColumn("sample_id", F.split("sample_id", "-")[0])
    return rounded(mt.sample_loss(p, "logit_zero"), "sample_mse", "sample_is_zero_bce", "sample_mean_loss", "sample_sum_loss")


CLS = """, c AS (SELECT label, predicted, count(*)::DOUBLE AS n FROM cpred GROUP BY 1, 2), k AS (SELECT label AS c FROM c UNION SELECT predicted FROM c),
  p AS (SELECT k.c, (SELECT coalesce(sum(n), 0) FROM c WHERE label = k.c) AS t, (SELECT coalesce(sum(n), 0) FROM c WHERE predicted = k.c) AS p,
    (SELECT coalesce(sum(n), 0) FROM c WHERE label = k.c AND predicted = k.c) AS h FROM k)"""


@query("met_classification", views("cpred") + CLS + """SELECT round(sum(h) / sum(t), 6) AS accuracy, round(avg(CASE WHEN p > 0 THEN h / p ELSE 0 END), 6) AS "precision",
  round(avg(CASE WHEN t > 0 THEN h / t ELSE 0 END), 6) AS recall, round(avg(2 * h / (p + t)), 6) AS f1,
  round((sum(h) * sum(t) - sum(p * t)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))), 6) AS mcc FROM p""")
def _(t):
    return rounded(mt.classification(t.cpred), "accuracy", "precision", "recall", "f1", "mcc")


@query("met_confusion", views("cpred") + "SELECT label, predicted, count(*) AS n FROM cpred GROUP BY 1, 2")
def _(t):
    return mt.confusion(t.cpred)


@query("met_class_scores", views("cpred") + """, l AS (SELECT label, 'A' AS class, logit_a AS s FROM cpred UNION ALL SELECT label, 'N', logit_n FROM cpred UNION ALL SELECT label, 'R', logit_r FROM cpred),
  f AS (SELECT class, s, count(*) AS n, count(*) FILTER (label = class) AS p FROM l GROUP BY 1, 2),
  g AS (SELECT *, coalesce(sum(n) OVER w, 0) AS nb, sum(n) OVER (PARTITION BY class) AS nt, sum(p) OVER (PARTITION BY class) AS pt, coalesce(sum(p) OVER w, 0) AS pb
    FROM f WINDOW w AS (PARTITION BY class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT class, round((sum((nb + (n + 1) / 2) * p) - any_value(pt) * (any_value(pt) + 1) / 2) / (any_value(pt) * (any_value(nt) - any_value(pt))), 6) AS auc,
    round(sum(p / pt * ((pt - pb) / (nt - nb))), 6) AS ap FROM g GROUP BY 1""")
def _(t):
    return rounded(mt.class_scores(t.cpred, LOGITS), "auc", "ap")


@query("met_accuracy_by_target", views("cpred") + """, s AS (SELECT label, avg((label = predicted)::INT) AS m, count(*) AS n FROM cpred GROUP BY 1)
  SELECT label, round(m, 6) AS accuracy, n AS "count", round(greatest(0, (m + 3.8416 / (2 * n) - 1.96 * sqrt(m * (1 - m) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS lower,
    round(least(1, (m + 3.8416 / (2 * n) + 1.96 * sqrt(m * (1 - m) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS upper FROM s""")
def _(t):
    return rounded(mt.accuracy_by_target(t.cpred), "accuracy", "lower", "upper")


@query("met_regression", views("pred") + """SELECT round(avg(abs(predicted - label)), 6) AS mae, round(avg((predicted - label) * (predicted - label)), 4) AS mse, round(corr(predicted, label), 6) AS pcc,
  count(*) FILTER (label = 0 AND predicted = 0) AS zero_zero, count(*) FILTER (label = 0 AND predicted <> 0) AS zero_nonzero,
  count(*) FILTER (label <> 0 AND predicted = 0) AS nonzero_zero, count(*) FILTER (label <> 0 AND predicted <> 0) AS nonzero_nonzero FROM pred""")
def _(t):
    return rounded(rounded(mt.regression(t.pred), "mae", "pcc"), "mse", digits=4)


@query("met_density", views("pred") + """, e AS (SELECT min(label) l0, (max(label) - min(label)) / 40 lw, min(predicted) p0, (max(predicted) - min(predicted)) / 40 pw FROM pred)
  SELECT CAST(least(floor((label - l0) / lw), 39) AS BIGINT) AS label_bin, CAST(least(floor((predicted - p0) / pw), 39) AS BIGINT) AS predicted_bin, count(*) AS n FROM pred, e GROUP BY 1, 2""")
def _(t):
    return mt.density(t.pred, 40)


@query("met_top_classes", views("cpred") + """, l AS (SELECT sample_id, 'A' AS class, logit_a AS logit FROM cpred UNION ALL SELECT sample_id, 'N', logit_n FROM cpred UNION ALL SELECT sample_id, 'R', logit_r FROM cpred),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY logit DESC, class) - 1 AS INTEGER) AS pos FROM l)
  SELECT sample_id, pos, class, logit FROM r WHERE pos < 2""")
def _(t):
    return mt.top_classes(t.cpred, LOGITS, 2)


@query("met_masked_accuracy", views("cpred") + f"SELECT round(avg(({LID} = CASE predicted WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT), 6) AS accuracy FROM cpred WHERE {LID} <> -100")
def _(t):
    p = F.when(F.col("predicted") == "A", 0).when(F.col("predicted") == "N", 1).otherwise(2)
    return rounded(mt.masked_accuracy(with_logits(t).select(F.col("label_id").alias("label"), p.alias("predicted"))), "accuracy")


@query("met_perplexity", views("cpred") + f"""SELECT round(exp(avg(ln(exp(logit_a) + exp(logit_n) + exp(logit_r)) - CASE {LID} WHEN 0 THEN logit_a WHEN 1 THEN logit_n ELSE logit_r END)), 6) AS perplexity
  FROM cpred WHERE {LID} <> -100""")
def _(t):
    return rounded(mt.perplexity(with_logits(t)), "perplexity")


@query("met_token_value_mse", views("cpred") + f"""SELECT round(avg(((exp(logit_n) * 2.5 + exp(logit_r) * 4) / (exp(logit_n) + exp(logit_r)) - CASE {LID} WHEN 1 THEN 2.5 ELSE 4 END) ** 2), 6) AS token_value_mse
  FROM cpred WHERE {LID} IN (1, 2)""")
def _(t):
    return rounded(mt.token_value_mse(with_logits(t).where("label_id <> 0"), [None, 2.5, 4.0]), "token_value_mse")


@query("met_softmax", views("cpred") + """SELECT sample_id, round(exp(logit_a) / (exp(logit_a) + exp(logit_n) + exp(logit_r)), 6) AS prob_a, round(exp(logit_n) / (exp(logit_a) + exp(logit_n) + exp(logit_r)), 6) AS prob_n,
  round(exp(logit_r) / (exp(logit_a) + exp(logit_n) + exp(logit_r)), 6) AS prob_r FROM cpred""")
def _(t):
    p = with_logits(t).select("sample_id", mt.softmax(F.col("logits")).alias("p"))
    return rounded(p.select("sample_id", *[F.col("p")[i].alias(f"prob_{k}") for i, k in enumerate("anr")]), "prob_a", "prob_n", "prob_r")


@query("met_run_summary", "WITH " + BOOT + """ SELECT metric, round(avg(value), 2) AS mean, round(quantile_cont(value, 0.025), 3) AS lower, round(quantile_cont(value, 0.975), 3) AS upper FROM b GROUP BY 1""")
def _(t):
    return mt.run_summary(_boot_runs(t))


def attributions(t):
    return t.lineitem.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("gene"), (F.col("l_discount") - 0.04 - (F.col("l_suppkey") % 5) / 100).alias("score"))


@query("met_attr_mean", """WITH a AS (SELECT 'S' || l_suppkey AS gene, l_discount - 0.04 - (l_suppkey % 5) / 100 AS score FROM lineitem)
  SELECT gene, round(avg(score), 6) AS attribution, count(*) AS n, round(avg(score) / (stddev_samp(score) / sqrt(count(*))), 5) AS t FROM a GROUP BY 1""")
def _(t):
    out = mt.mean_attributions(attributions(t)).select("gene", "attribution", "n", "t")
    return rounded(rounded(out, "attribution"), "t", digits=5)


@query("met_attr_significance", """WITH a AS (SELECT 'S' || l_suppkey AS gene, l_discount - 0.04 - (l_suppkey % 5) / 100 AS score FROM lineitem),
  g AS (SELECT gene, avg(score) AS attribution, count(*) AS n, avg(score) / (stddev_samp(score) / sqrt(count(*))) AS t FROM a GROUP BY 1 HAVING count(*) > 1 AND stddev_samp(score) > 0),
  x AS (SELECT *, (n - 1)::DOUBLE AS v, (n - 1) / (n - 1 + t * t) AS x FROM g),
  w AS (SELECT gene, v, x, i, i * 0.002 AS w FROM x, (SELECT unnest(range(4001)) AS i)),
  f AS (SELECT gene, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * CASE WHEN i > 0 THEN 2 * w * exp(-w * w) / sqrt(1 - x * exp(-2 * w * w / v)) WHEN x = 1 THEN sqrt(2 * v) ELSE 0 END) * 0.002 / 3 AS s FROM w GROUP BY 1),
  p AS (SELECT x.*, v / 2 * ln(x) + ln(2 / v) + ln(s) - (lgamma(v / 2) + lgamma(0.5) - lgamma(v / 2 + 0.5)) AS lp FROM x JOIN f USING (gene))
  SELECT gene, round(attribution, 6) AS attribution, n, round(t, 5) AS t, round(exp(lp), 6) AS p_value, round(-lp / ln(2), 3) AS neg_log2_p,
    exp(lp) < 0.05 / count(*) OVER () AND abs(attribution) > 0.01 AS highlight FROM p""")
def _(t):
    """The twin integrates the tail of Student's t by Simpson's rule."""
    out = mt.mean_attributions(attributions(t), least=0.01)
    return rounded(rounded(rounded(out, "attribution", "p_value"), "t", digits=5), "neg_log2_p", digits=3)
"""Queries for aggregations and statistics."""

import math
from itertools import accumulate

from pyspark.sql import functions as F

from tallgene.functions.rand import hash_uniform_sql
from tallgene.operators import stats as st
from tallgene.plans.bind import views
from tallgene.plans.cells import QC_SQL, cell_qc
from tallgene.plans.registry import query, rounded

QC = views("expr", "var")[:-1] + ", " + QC_SQL


@query("agg_qc_cells", views("expr", "var") + """SELECT cell_id, sum(value) AS total_counts, count(*) AS n_genes_by_counts,
  sum(CASE WHEN mito THEN value ELSE 0 END) AS total_counts_mt, round(100 * sum(CASE WHEN mito THEN value ELSE 0 END) / sum(value), 6) AS pct_counts_mt
  FROM expr JOIN var USING (gene) GROUP BY 1""")
def _(t):
    return rounded(st.qc_cells(t.expr, t.var), "pct_counts_mt")


@query("agg_qc_genes", views("expr", "obs") + """SELECT gene, count(*) AS n_cells_by_counts, sum(value) AS total_counts,
  round(sum(value) / (SELECT count(*) FROM obs), 6) AS mean_counts, round(100 * (1 - count(*) / (SELECT count(*) FROM obs)), 6) AS pct_dropout_by_counts
  FROM expr GROUP BY 1""")
def _(t):
    return rounded(st.qc_genes(t.expr, t.obs), "mean_counts", "pct_dropout_by_counts")


@query("agg_qc_removed_report", QC + """SELECT count(*) AS n_cells, count(*) FILTER (total_counts < 30) AS total_counts_under,
  count(*) FILTER (total_counts > 200) AS total_counts_over, count(*) FILTER (n_genes < 2) AS n_genes_under, count(*) FILTER (n_genes > 8) AS n_genes_over,
  count(*) FILTER (total_counts < 30 OR total_counts > 200 OR n_genes < 2 OR n_genes > 8) AS n_removed,
  round(100 * count(*) FILTER (total_counts < 30 OR total_counts > 200 OR n_genes < 2 OR n_genes > 8) / count(*), 6) AS pct_removed FROM qc""")
def _(t):
    return rounded(st.qc_removed_report(cell_qc(t), {"total_counts": (30, 200), "n_genes": (2, 8)}), "pct_removed")


@query("agg_percentile_lines", QC + """SELECT q1, m AS median, q3, round(m - 1.5 * (q3 - q1), 6) AS low, round(m + 1.5 * (q3 - q1), 6) AS high
  FROM (SELECT quantile_cont(total_counts, 0.25) q1, median(total_counts) m, quantile_cont(total_counts, 0.75) q3 FROM qc)""")
def _(t):
    return rounded(st.percentile_lines(cell_qc(t), "total_counts"), "low", "high")


def hist_sql(x: str, bins: int) -> str:
    return f"""x AS (SELECT {x} AS x FROM qc), b AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
  h AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS BIGINT) AS bin, count(*) AS n FROM x, b GROUP BY 1)
  SELECT bin, round(lo + (hi - lo) / {bins} * bin, 6) AS left_edge, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cumulative FROM h, b"""


@query("agg_histogram", QC + ", " + hist_sql("total_counts", 50))
def _(t):
    return rounded(st.histogram(cell_qc(t), "total_counts", 50), "left_edge", "cumulative")


@query("agg_histogram_log", QC + ", " + hist_sql("log10(total_counts)", 20))
def _(t):
    return rounded(st.histogram(cell_qc(t), "total_counts", 20, log=True), "left_edge", "cumulative")


@query("agg_gene_median", views("expr") + "SELECT gene, median(value) AS median FROM expr GROUP BY 1")
def _(t):
    return st.gene_median(t.expr)


@query("agg_gene_quantiles", views("expr") + """SELECT gene, quantile_cont(value, 0.5) AS q50, round(quantile_cont(value, 0.75), 6) AS q75,
  round(quantile_cont(value, 0.9), 6) AS q90 FROM expr GROUP BY 1""")
def _(t):
    return rounded(st.gene_quantiles(t.expr), "q75", "q90")


@query("agg_max", views("expr") + """SELECT 'gene' AS kind, gene, max(value) AS value FROM expr GROUP BY ALL
  UNION ALL SELECT 'global', NULL, max(value) FROM expr
  UNION ALL SELECT 'top3', NULL, max(s) FROM (SELECT sum(value) AS s FROM (SELECT * FROM expr
    QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene) <= 3) GROUP BY cell_id)""")
def _(t):
    none = F.lit(None).cast("string").alias("gene")
    a = st.gene_max(t.expr).select(F.lit("gene").alias("kind"), "gene", "value")
    b = st.max_expression(t.expr).select(F.lit("global").alias("kind"), none, "value")
    c = st.max_counts(t.expr, 3).select(F.lit("top3").alias("kind"), none, "value")
    return a.unionByName(b).unionByName(c)


SPLIT = "CASE batch WHEN 'F' THEN 'train' WHEN 'O' THEN 'dev' ELSE 'test' END"
GM_SQL = f""", n AS (SELECT perturbation, count(*) AS n FROM pobs GROUP BY 1),
  m AS (SELECT perturbation, gene, sum(value) / any_value(n) AS mean FROM pexpr JOIN pobs USING (cell_id) JOIN n USING (perturbation) GROUP BY 1, 2),
  tr AS (SELECT DISTINCT perturbation FROM pobs WHERE {SPLIT} = 'train' AND perturbation <> 'Control')"""


def psplit(t):
    b = F.col("batch")
    return t.pobs.withColumn("split", F.when(b == "F", "train").when(b == "O", "dev").otherwise("test"))


@query("agg_group_means", views("pexpr", "pobs") + GM_SQL + """SELECT perturbation, gene, round(mean, 6) AS mean FROM m
  UNION ALL SELECT 'Average_Perturbation_Train', gene, round(sum(mean) / (SELECT count(*) FROM tr), 6) FROM m WHERE perturbation IN (SELECT perturbation FROM tr) GROUP BY 2""")
def _(t):
    return rounded(st.group_means(t.pexpr, psplit(t)), "mean")


@query("agg_group_means_exp", views("pexpr", "pobs") + """, e AS (SELECT cell_id, gene, ln(1 + value) AS value FROM pexpr),
  n AS (SELECT perturbation, count(*) AS n FROM pobs GROUP BY 1)
  SELECT perturbation, gene, round(ln(1 + sum(exp(value) - 1) / any_value(n)), 6) AS mean FROM e JOIN pobs USING (cell_id) JOIN n USING (perturbation) GROUP BY 1, 2""")
def _(t):
    e = t.pexpr.withColumn("value", F.log1p("value"))
    return rounded(st.plain_group_means(e, t.pobs, ["perturbation"], exp_before_mean=True), "mean")


@query("agg_fileset_means", views("pexpr", "pobs") + f""", f AS (SELECT cell_id, perturbation, {SPLIT} AS s FROM pobs),
  c AS (SELECT cell_id, perturbation, CASE WHEN perturbation <> 'Control' THEN s END AS split FROM f WHERE s = 'train' OR (s <> 'train' AND perturbation <> 'Control')),
  n AS (SELECT perturbation, count(*) AS n FROM c GROUP BY 1),
  m AS (SELECT perturbation, gene, sum(value) / any_value(n) AS mean FROM pexpr JOIN c USING (cell_id) JOIN n USING (perturbation) GROUP BY 1, 2),
  tr AS (SELECT DISTINCT perturbation FROM c WHERE split = 'train')
  SELECT perturbation, gene, round(mean, 6) AS mean FROM m UNION ALL SELECT 'Average_Perturbation_Train', gene,
    round(sum(mean) / (SELECT count(*) FROM tr), 6) FROM m WHERE perturbation IN (SELECT perturbation FROM tr) GROUP BY 2""")
def _(t):
    cells = psplit(t)
    files = {s: (t.pexpr, cells.where(F.col("split") == s)) for s in ("train", "dev", "test")}
    return rounded(st.fileset_means(files), "mean")


@query("agg_control_means", views("pexpr", "pobs") + """, n AS (SELECT cell_type, count(*) AS n FROM pobs WHERE perturbation = 'Control' GROUP BY 1)
  SELECT cell_type, gene, round(sum(value) / any_value(n), 6) AS mean FROM pexpr JOIN pobs USING (cell_id) JOIN n USING (cell_type)
  WHERE perturbation = 'Control' GROUP BY 1, 2""")
def _(t):
    return rounded(st.control_means(t.pexpr, t.pobs), "mean")


KEYED = """k AS (SELECT cell_id, batch AS split, substr(cell_type, 3) || '_' || replace(perturbation, '_', '+') || '_0.' || (1 + length(perturbation) % 3) AS key,
    replace(perturbation, '_', '+') AS product_name, 'C' || cell_id AS smiles FROM pobs)"""


def keyed(t):
    prod = F.replace(F.col("perturbation"), F.lit("_"), F.lit("+"))
    dose = F.concat(F.lit("_0."), (1 + F.length("perturbation") % 3).cast("string"))
    return t.pobs.select(
        "cell_id", F.col("batch").alias("split"), F.concat(F.expr("substr(cell_type, 3)"), F.lit("_"), prod, dose).alias("key"),
        prod.alias("product_name"), F.concat(F.lit("C"), "cell_id").alias("smiles"))


@query("agg_group_means_by_key", views("pexpr", "pobs")[:-1] + ", " + KEYED + """,
  n AS (SELECT split, key, count(*) AS n FROM k GROUP BY 1, 2), d AS (SELECT product_name, arg_min(smiles, cell_id) AS smiles FROM k GROUP BY 1),
  m AS (SELECT split, key, gene, sum(value) / any_value(n) AS mean FROM pexpr JOIN k USING (cell_id) JOIN n USING (split, key) GROUP BY 1, 2, 3)
  SELECT split, key, gene, round(mean, 6) AS mean, string_split(key, '_')[1] AS cell_type, string_split(key, '_')[2] AS product_name,
    round(CAST(string_split(key, '_')[3] AS DOUBLE) * 10000, 6) AS dose, d.smiles FROM m LEFT JOIN d ON d.product_name = string_split(key, '_')[2]""")
def _(t):
    return rounded(st.group_means_by_key(t.pexpr, keyed(t)), "mean", "dose")


HVG_IN = """, e AS (SELECT cell_id, gene, ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 1000) AS value FROM expr)"""


def hvg_input(t):
    from tallgene.operators import normalise as nm

    return nm.log_transform(nm.normalize_total(t.expr, 1000))


@query("agg_hvg", views("expr", "obs") + HVG_IN + """, s AS (SELECT gene, sum(exp(value) - 1) AS s, sum((exp(value) - 1) * (exp(value) - 1)) AS ss FROM e GROUP BY 1),
  n AS (SELECT count(*)::DOUBLE AS n FROM obs),
  m AS (SELECT gene, s / n AS mu, (ss - s * s / n) / (n - 1) AS v FROM s, n),
  g AS (SELECT gene, ln(1 + mu) AS mean, ln(v / mu) AS dispersion FROM m WHERE mu > 0),
  r AS (SELECT min(mean) AS lo, (max(mean) - min(mean)) / 20 AS w FROM g),
  b AS (SELECT gene, mean, dispersion, CAST(least(greatest(1, ceil((mean - lo) / w)), 20) AS INTEGER) AS bin FROM g, r),
  z AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY bin) = 1 THEN 1.0 ELSE (dispersion - avg(dispersion) OVER (PARTITION BY bin))
    / stddev_samp(dispersion) OVER (PARTITION BY bin) END AS dn FROM b)
  SELECT gene, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, bin, round(dn, 6) AS dispersion_norm,
    row_number() OVER (ORDER BY dn DESC, gene) <= 200 AS highly_variable FROM z""")
def _(t):
    return rounded(st.highly_variable_genes(hvg_input(t), t.obs, n_top_genes=200), "mean", "dispersion", "dispersion_norm")


@query("agg_hvg_cell_ranger", views("expr", "obs") + """, s AS (SELECT gene, sum(value) AS s, sum(value * value) AS ss FROM expr GROUP BY 1),
  n AS (SELECT count(*)::DOUBLE AS n FROM obs),
  g AS (SELECT gene, s / n AS mean, (ss - s * s / n) / (n - 1) / (s / n) AS dispersion FROM s, n),
  q AS (SELECT quantile_cont(mean, [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]) AS e FROM g),
  b AS (SELECT g.*, CAST(len(list_filter(e, lambda x: x + 1e-12 < mean)) AS INTEGER) AS bin FROM g, q),
  d AS (SELECT bin, median(dispersion) AS med FROM b GROUP BY 1),
  a AS (SELECT bin, any_value(med) AS med, median(abs(dispersion - med)) / 0.6744897501960817 AS mad FROM b JOIN d USING (bin) GROUP BY 1),
  z AS (SELECT b.*, (dispersion - med) / nullif(mad, 0) AS dn FROM b JOIN a USING (bin))
  SELECT gene, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, round(dn, 6) AS dispersion_norm,
    coalesce(mean > 0.0125 AND mean < 3 AND dn > 0.5, FALSE) AS highly_variable FROM z""")
def _(t):
    out = st.highly_variable_genes(t.expr, t.obs, flavor="cell_ranger")
    return rounded(out.drop("bin"), "mean", "dispersion", "dispersion_norm")


@query("agg_hvg_batch", views("expr", "obs") + HVG_IN + """, n AS (SELECT batch, count(*)::DOUBLE AS n FROM obs GROUP BY 1),
  s AS (SELECT batch, gene, sum(exp(value) - 1) AS s, sum((exp(value) - 1) * (exp(value) - 1)) AS ss FROM e JOIN obs USING (cell_id) GROUP BY 1, 2),
  m AS (SELECT batch, gene, s / n AS mu, (ss - s * s / n) / (n - 1) AS v FROM s JOIN n USING (batch)),
  g AS (SELECT batch, gene, ln(1 + mu) AS mean, ln(v / mu) AS dispersion FROM m),
  b AS (SELECT *, CAST(least(greatest(1, ceil((mean - min(mean) OVER w) / ((max(mean) OVER w - min(mean) OVER w) / 20))), 20) AS INTEGER) AS bin
    FROM g WINDOW w AS (PARTITION BY batch)),
  z AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE (dispersion - avg(dispersion) OVER w) / stddev_samp(dispersion) OVER w END AS dn
    FROM b WINDOW w AS (PARTITION BY batch, bin)),
  t AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY dn DESC, gene) <= 300 AS hv FROM z)
  SELECT gene, round(avg(mean), 6) AS mean, round(avg(dispersion), 6) AS dispersion, round(avg(dn), 6) AS dispersion_norm,
    count(*) FILTER (hv) AS n_batches_variable, count(*) FILTER (hv) = 3 AS in_all_batches,
    row_number() OVER (ORDER BY count(*) FILTER (hv) DESC, avg(dn) DESC, gene) <= 300 AS highly_variable FROM t GROUP BY gene""")
def _(t):
    out = st.highly_variable_genes(hvg_input(t), t.obs, n_top_genes=300, batch_key="batch")
    return rounded(out, "mean", "dispersion", "dispersion_norm")


def fitted_sql(of: str) -> str:
    """Common table expressions of the local quadratic fit of y on x over all pairs of points (b, gene, x, y) of ``of``."""
    return f""", q AS (SELECT b, count(*) AS n, least(count(*), greatest(3, CAST(floor(count(*) * 0.3 + 1e-5) AS BIGINT))) AS q FROM {of} GROUP BY b),
  h AS (SELECT p.b, p.gene, p.x, list_sort(list(abs(o.x - p.x)))[any_value(q)] AS h FROM {of} p JOIN {of} o USING (b) JOIN q USING (b) GROUP BY p.b, p.gene, p.x),
  u AS (SELECT h.b, h.gene, CASE WHEN h > 0 THEN (o.x - h.x) / h WHEN o.x = h.x THEN 0 ELSE 2 END AS u, o.y FROM h JOIN {of} o USING (b) WHERE abs(o.x - h.x) <= h),
  k AS (SELECT b, gene, u, y, pow(1 - pow(abs(u), 3), 3) AS w FROM u WHERE abs(u) < 1),
  mo AS (SELECT b, gene, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4,
    sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM k GROUP BY b, gene),
  de AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS d2, s0 * s2 - s1 * s1 AS d1 FROM mo),
  fit AS (SELECT b, gene, CASE WHEN d2 > 1e-10 * s0 * s0 * s0 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / d2
    WHEN d1 > 1e-10 * s0 * s0 THEN (t0 * s2 - t1 * s1) / d1 ELSE t0 / s0 END AS fit FROM de)"""


V3_SQL = """, n AS (SELECT b, count(*)::DOUBLE AS n FROM o GROUP BY b), e AS (SELECT b, gene, value FROM expr JOIN o USING (cell_id)),
  m AS (SELECT b, gene, any_value(n) AS n, sum(value) / any_value(n) AS mean, (sum(value * value) - sum(value) * (sum(value) / any_value(n))) / (any_value(n) - 1) AS v
    FROM e JOIN n USING (b) GROUP BY b, gene),
  pt AS (SELECT b, gene, log10(mean) AS x, log10(v) AS y FROM m WHERE v > 0)""" + fitted_sql("pt") + """,
  c AS (SELECT m.*, coalesce(pow(10, fit), 1) AS sd2 FROM m LEFT JOIN fit USING (b, gene)),
  z AS (SELECT b, gene, any_value(mean) AS mean, any_value(v) AS v,
    (sum(pow(least(value, sqrt(sd2) * sqrt(n) + mean) - mean, 2)) + (any_value(n) - count(*)) * pow(any_value(mean), 2)) / ((any_value(n) - 1) * any_value(sd2)) AS vn
    FROM e JOIN c USING (b, gene) GROUP BY b, gene),
  rk AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(vn, 9) DESC, gene) - 1 AS r FROM z),
  g AS (SELECT gene, avg(mean) AS mean, avg(v) AS v, avg(vn) AS vn, count(*) FILTER (r < 100) AS nb, median(r) FILTER (r < 100) AS rank FROM rk GROUP BY gene)"""
PEARSON_SQL = """, e AS (SELECT b, cell_id, gene, value FROM expr JOIN o USING (cell_id)), n AS (SELECT b, count(*)::DOUBLE AS n FROM o GROUP BY b),
  ct AS (SELECT b, cell_id, sum(value) AS total FROM e GROUP BY ALL), bt AS (SELECT b, sum(total) AS mass FROM ct GROUP BY b),
  gs AS (SELECT b, gene, sum(value) AS s, sum(value * value) AS ss FROM e GROUP BY ALL),
  d AS (SELECT b, gene, n, s, ss, greatest(-sqrt(n), least(sqrt(n), (coalesce(value, 0) - total * s / mass) / sqrt(total * s / mass + pow(total * s / mass, 2) / 100))) AS r
    FROM gs JOIN bt USING (b) JOIN n USING (b) JOIN ct USING (b) LEFT JOIN e USING (b, cell_id, gene)),
  z AS (SELECT b, gene, any_value(s / n) AS mean, any_value((ss - s * s / n) / (n - 1)) AS v, sum(r * r) / any_value(n) - pow(sum(r) / any_value(n), 2) AS vn FROM d GROUP BY b, gene),
  rk AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(vn, 9) DESC, gene) - 1 AS r FROM z),
  g AS (SELECT gene, avg(mean) AS mean, avg(v) AS v, avg(vn) AS vn, count(*) FILTER (r < 100) AS nb, median(r) FILTER (r < 100) AS rank FROM rk GROUP BY gene)"""
TOP_SQL = """SELECT gene, round(mean, 6) AS mean, round(v, 6) AS variance, round(vn, 6) AS variance_norm, nb AS n_batches_variable, rank,
  row_number() OVER (ORDER BY {order}, round(vn, 9) DESC, gene) <= 100 AS highly_variable FROM g"""
ONE_BATCH, BATCHES = ", o AS (SELECT cell_id, 1 AS b FROM obs)", ", o AS (SELECT cell_id, batch AS b FROM obs)"
RANK_FIRST, BATCHES_FIRST = "rank NULLS LAST, nb DESC", "nb DESC, rank NULLS LAST"


def top_variable(t, flavor, **options):
    return rounded(st.highly_variable_genes(t.expr, t.obs, flavor=flavor, n_top_genes=100, **options), "mean", "variance", "variance_norm")


@query("agg_hvg_seurat_v3", views("expr", "obs") + ONE_BATCH + V3_SQL + TOP_SQL.format(order=RANK_FIRST))
def _(t):
    return top_variable(t, "seurat_v3")


@query("agg_hvg_seurat_v3_batch", views("expr", "obs") + BATCHES + V3_SQL + TOP_SQL.format(order=RANK_FIRST))
def _(t):
    return top_variable(t, "seurat_v3", batch_key="batch")


@query("agg_hvg_pearson_residuals", views("expr", "obs") + ONE_BATCH + PEARSON_SQL + TOP_SQL.format(order=BATCHES_FIRST))
def _(t):
    return top_variable(t, "pearson_residuals")


@query("agg_hvg_pearson_residuals_batch", views("expr", "obs") + BATCHES + PEARSON_SQL + TOP_SQL.format(order=BATCHES_FIRST))
def _(t):
    return top_variable(t, "pearson_residuals", batch_key="batch")


DE_SQL = """, n AS (SELECT perturbation, count(*)::DOUBLE AS n FROM pobs GROUP BY 1),
  s AS (SELECT perturbation, gene, sum(value) AS s, sum(value * value) AS ss FROM pexpr JOIN pobs USING (cell_id) GROUP BY 1, 2),
  f AS (SELECT n.perturbation, n.n, g.gene, coalesce(s.s, 0) AS s, coalesce(s.ss, 0) AS ss FROM n CROSS JOIN (SELECT DISTINCT gene FROM s) g
    LEFT JOIN s ON s.perturbation = n.perturbation AND s.gene = g.gene),
  m AS (SELECT perturbation, gene, n, s / n AS mu, greatest(0, (ss - s * (s / n)) / (n - 1)) AS v FROM f WHERE n > 1),
  t AS (SELECT a.perturbation, a.gene, a.mu AS mean, c.mu AS control_mean,
    CASE WHEN a.v / a.n + c.v / c.n > 0 THEN (a.mu - c.mu) / sqrt(a.v / a.n + c.v / c.n) ELSE 0 END AS score
    FROM m a JOIN m c ON c.gene = a.gene AND c.perturbation = 'Control' WHERE a.perturbation <> 'Control'),
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY perturbation ORDER BY round(abs(score), 9) DESC, gene) AS INTEGER) AS rank FROM t)"""


@query("agg_de_rank", views("pexpr", "pobs") + DE_SQL + """SELECT perturbation, gene, round(mean, 6) AS mean, round(control_mean, 6) AS control_mean,
  round(score, 6) AS score, rank FROM rk WHERE rank <= 15""")
def _(t):
    return rounded(st.de_rank(st.de_scores(t.pexpr, t.pobs), 15), "mean", "control_mean", "score")


@query("agg_de_nonzero_nondropout", views("pexpr", "pobs") + DE_SQL + """, k AS (SELECT perturbation, 'non_zero' AS kind, rank, gene FROM rk WHERE mean <> 0
  UNION ALL SELECT perturbation, 'non_dropout', rank, gene FROM rk WHERE mean <> 0 OR control_mean = 0)
  SELECT * FROM (SELECT perturbation, kind, CAST(row_number() OVER (PARTITION BY perturbation, kind ORDER BY rank) AS INTEGER) AS pos, gene FROM k) WHERE pos <= 20""")
def _(t):
    return st.de_nonzero_nondropout(st.de_rank(st.de_scores(t.pexpr, t.pobs), 50))


@query("agg_crosstab", """WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2),
  rr AS (SELECT source, CAST(row_number() OVER (ORDER BY count(*) DESC, source) AS INTEGER) AS row_rank FROM n GROUP BY 1),
  cc AS (SELECT lang, CAST(row_number() OVER (ORDER BY count(*) DESC, lang) AS INTEGER) AS col_rank FROM n GROUP BY 1)
  SELECT source, lang, row_rank, col_rank, coalesce(n, 0) AS n FROM rr CROSS JOIN cc LEFT JOIN n USING (source, lang)""")
def _(t):
    return st.crosstab_sorted(t.documents, "source", "lang").select("source", "lang", "row_rank", "col_rank", "n")


@query("agg_split_balance", """SELECT l_linestatus AS split, l_returnflag AS cell_type, count(*) AS n_cells, count(DISTINCT l_suppkey) AS n_datasets
  FROM lineitem GROUP BY 1, 2""")
def _(t):
    cells = t.lineitem.select(F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("cell_type"), F.col("l_suppkey").alias("dataset"))
    return st.split_balance(cells)


@query("agg_crosstab2", """SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY') AS "ECONOMY", count(*) FILTER (p_type = 'LARGE') AS "LARGE",
  count(*) FILTER (p_type = 'MEDIUM') AS "MEDIUM", count(*) FILTER (p_type = 'PROMO') AS "PROMO", count(*) FILTER (p_type = 'SMALL') AS "SMALL", count(*) FILTER (p_type = 'STANDARD') AS "STANDARD" FROM part GROUP BY 1""")
def _(t):
    return st.crosstab_wide(t.part, "p_brand", "p_type")


@query("agg_distinct_profile", """SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS n_distinct, 0::BIGINT AS n_null, count(*) AS n_rows FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type), 0, count(*) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size), 0, count(*) FROM part""")
def _(t):
    return st.distinct_profile(t.part, ["p_brand", "p_type", "p_size"])


@query("agg_distinct_pairs", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def _(t):
    return st.distinct_pairs(t.lineitem, "l_suppkey", "l_partkey")


FEATURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}


def features(t):
    return t.lineitem.select(*[F.col(v).alias(k) for k, v in FEATURES.items()])


def _corr_sql():
    parts = [f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({x}, {y}), 6) AS corr FROM lineitem"
             for a, x in FEATURES.items() for b, y in FEATURES.items()]
    return " UNION ALL ".join(parts)


@query("agg_feature_corr", _corr_sql())
def _(t):
    return rounded(st.feature_correlation(features(t), list(FEATURES)), "corr")


@query("agg_feature_mi", """WITH f AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem),
  g AS (SELECT min(a) a0, max(a) a1, min(b) b0, max(b) b1, min(c) c0, max(c) c1 FROM f),
  x AS (SELECT least(floor((a - a0) / (a1 - a0) * 10), 9) AS a, least(floor((b - b0) / (b1 - b0) * 10), 9) AS b,
    least(floor((c - c0) / (c1 - c0) * 10), 9) AS c FROM f, g),
  p AS (SELECT 'quantity' AS f1, 'price' AS f2, a AS x, b AS y FROM x UNION ALL SELECT 'quantity', 'discount', a, c FROM x UNION ALL SELECT 'price', 'discount', b, c FROM x),
  j AS (SELECT f1, f2, x, y, count(*)::DOUBLE AS c FROM p GROUP BY ALL),
  k AS (SELECT *, sum(c) OVER (PARTITION BY f1, f2) AS n, sum(c) OVER (PARTITION BY f1, f2, x) AS cx, sum(c) OVER (PARTITION BY f1, f2, y) AS cy FROM j),
  s AS (SELECT f1, f2, sum(c / n * ln(c * n / (cx * cy))) AS mi, sum(-c / n * ln(cx / n)) AS hx, sum(-c / n * ln(cy / n)) AS hy FROM k GROUP BY 1, 2)
  SELECT f1, f2, round(mi, 6) AS mi, round(mi / greatest(hx, hy), 6) AS nmi FROM s""")
def _(t):
    return rounded(st.feature_mutual_information(features(t), list(FEATURES), 10), "mi", "nmi")


@query("agg_pert_distance", views("pexpr", "pobs") + GM_SQL + """, g AS (SELECT p.perturbation, x.gene, coalesce(m.mean, 0) AS mean, coalesce(c.mean, 0) AS c
  FROM (SELECT DISTINCT perturbation FROM m WHERE perturbation <> 'Control') p CROSS JOIN (SELECT DISTINCT gene FROM m) x
  LEFT JOIN m ON m.perturbation = p.perturbation AND m.gene = x.gene LEFT JOIN m c ON c.perturbation = 'Control' AND c.gene = x.gene)
  SELECT perturbation, round(1 - corr(mean, c), 6) AS distance FROM g GROUP BY 1""")
def _(t):
    return rounded(st.perturbation_distance(st.plain_group_means(t.pexpr, t.pobs, ["perturbation"])), "distance")


def net_sql(rows: str, a: str, b: str, y: str, reg: float, run: str = "0", weight: str = "1.0") -> str:
    """SELECT of (run, feature, coefficient) of the elastic net on two features; 400 rounds of coordinate descent."""
    return f"""SELECT run, unnest(['{a}', '{b}']) AS feature, unnest([b1, b2]) AS coefficient FROM (
    WITH RECURSIVE w AS (SELECT {run} AS run, ({a})::DOUBLE AS a, ({b})::DOUBLE AS b, ({y})::DOUBLE AS y, ({weight})::DOUBLE AS w FROM {rows}),
      mu AS (SELECT run, sum(w) AS n, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * y) / sum(w) AS my FROM w GROUP BY run),
      sd AS (SELECT run, any_value(n) AS n, sqrt(sum(w * (a - ma) * (a - ma)) / any_value(n)) AS sa, sqrt(sum(w * (b - mb) * (b - mb)) / any_value(n)) AS sb,
        sum(w * (a - ma) * (b - mb)) / any_value(n) AS cab, sum(w * (a - ma) * (y - my)) / any_value(n) AS cay, sum(w * (b - mb) * (y - my)) / any_value(n) AS cby FROM w JOIN mu USING (run) GROUP BY run),
      it AS (SELECT run, 0 AS i, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM sd UNION ALL
        SELECT run, i + 1, c1, sign(cby / sb - g * c1) * greatest(0, abs(cby / sb - g * c1) - {reg} * 0.5) / (1 + {reg} * 0.5) FROM (
          SELECT it.run, i, cby, sb, cab / sa / sb AS g, sign(cay / sa - cab / sa / sb * b2) * greatest(0, abs(cay / sa - cab / sa / sb * b2) - {reg} * 0.5) / (1 + {reg} * 0.5) AS c1
          FROM it JOIN sd USING (run) WHERE i < 400))
    SELECT run, b1, b2 FROM it WHERE i = 400)"""


@query("agg_feature_regression", "SELECT feature, round(coefficient, 4) AS coefficient FROM (" + net_sql(
    "(SELECT l_quantity AS quantity, l_discount AS discount, l_extendedprice AS price FROM lineitem)", "quantity", "discount", "price", 1.0) + ")")
def _(t):
    return rounded(st.feature_regression(features(t), ["quantity", "discount"], "price", reg=1.0), "coefficient", digits=4)


KEY = "p_partkey"
POISSON_CUTS = list(accumulate(math.exp(-1) / math.factorial(i) for i in range(18)))
DRAWS = " UNION ALL ".join(f"SELECT {run} AS run, p_size, p_partkey % 13 AS k, p_retailprice, {' + '.join(f'({hash_uniform_sql(run, 0, KEY)} >= {c!r}::DOUBLE)::INT' for c in POISSON_CUTS)} AS times FROM part" for run in range(4))


@query("agg_selection_frequency", "SELECT feature, round(avg(coefficient), 4) AS mean_coef, round(stddev_samp(coefficient), 4) AS std_coef, round(avg((coefficient <> 0)::INT), 6) AS nonzero_frac FROM ("
       + net_sql(f"({DRAWS})", "p_size", "k", "p_retailprice", 0.5, "run", "times") + ") GROUP BY 1")
def _(t):
    from tallgene.operators.sampling import bootstrap

    fits = None
    for run in range(4):
        sample = bootstrap(t.part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 13).alias("k")), 1, seed=run, keys=["p_partkey"])
        one = st.feature_regression(sample, ["p_size", "k"], "p_retailprice", reg=0.5)
        fits = one if fits is None else fits.unionByName(one)
    return rounded(rounded(st.selection_frequency(fits), "mean_coef", "std_coef", digits=4), "nonzero_frac")


@query("agg_selection_frequency_table", """SELECT l_returnflag || l_linestatus AS feature, round(avg(l_discount - 0.05), 6) AS mean_coef,
  round(stddev_samp(l_discount - 0.05), 6) AS std_coef, round(avg((l_discount - 0.05 <> 0)::INT), 6) AS nonzero_frac FROM lineitem GROUP BY 1""")
def _(t):
    coef = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("feature"), (F.col("l_discount") - 0.05).alias("coefficient"))
    return rounded(st.selection_frequency(coef), "mean_coef", "std_coef", "nonzero_frac")


@query("agg_validate_counts", """WITH h AS (SELECT l_returnflag AS perturbation, count(*) AS n_cells FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
  q AS (SELECT l_returnflag AS perturbation, count(*) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS n_required FROM lineitem GROUP BY 1)
  SELECT perturbation, n_cells, n_required, CASE WHEN n_cells IS NULL THEN 'missing' WHEN n_required IS NULL THEN 'unexpected'
    WHEN n_cells <> n_required THEN 'mismatch' ELSE 'ok' END AS status FROM h FULL JOIN q USING (perturbation)""")
def _(t):
    cells = t.lineitem.select(F.col("l_returnflag").alias("perturbation"))
    need = cells.groupBy("perturbation").agg((F.count("*") + F.when(F.col("perturbation") == "R", 1).otherwise(0)).alias("n_required"))
    return st.validate_counts(cells.where("perturbation <> 'N'"), need)


@query("agg_variation_pct", """SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[ACGTN]', '', 'g')) / length(text) ELSE 0 END, 6) AS variation FROM documents""")
def _(t):
    return rounded(st.variation_share(t.documents.select("doc_id", F.col("text").alias("seq"))).select("doc_id", "variation"), "variation")


BOOT = f"""b AS (SELECT l_linestatus AS metric, l_partkey % 100 AS run, avg((l_returnflag = 'A')::INT) AS value FROM lineitem GROUP BY 1, 2)"""


def _boot_runs(t):
    return t.lineitem.groupBy(F.col("l_linestatus").alias("metric"), (F.col("l_partkey") % 100).alias("run")).agg(
        F.avg((F.col("l_returnflag") == "A").cast("int")).alias("value"))


@query("agg_ci", "WITH " + BOOT + """, p AS (SELECT l_linestatus AS metric, avg((l_returnflag = 'A')::INT) AS m, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)
  SELECT 'bootstrap_quantiles' AS method, metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper FROM b GROUP BY 1, 2
  UNION ALL SELECT 'bootstrap_t_interval', metric, round(avg(value), 6), round(avg(value) - 1.9842169515 * stddev_pop(value), 6), round(avg(value) + 1.9842169515 * stddev_pop(value), 6) FROM b GROUP BY 1, 2
  UNION ALL SELECT 'binomial', metric, round(m, 6), round(m - 1.96 * sqrt(m * (1 - m) / n), 6), round(m + 1.96 * sqrt(m * (1 - m) / n), 6) FROM p
  UNION ALL SELECT 'wilson', metric, round(m, 6),
    round(greatest(0, ((m + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(m * (1 - m) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6),
    round(least(1, ((m + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(m * (1 - m) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) FROM p
  """)
def _(t):
    parts = [st.bootstrap_ci(_boot_runs(t), ["metric"], method=m).select(F.lit(m).alias("method"), "metric", "mean", "lower", "upper")
             for m in ("bootstrap_quantiles", "bootstrap_t_interval")]
    p = t.lineitem.groupBy(F.col("l_linestatus").alias("metric")).agg(
        F.avg((F.col("l_returnflag") == "A").cast("int")).alias("mean"), F.count("*").alias("n"))
    for m in ("binomial", "wilson"):
        low, high = st.proportion_ci(F.col("mean"), F.col("n"), m)
        parts.append(p.select(F.lit(m).alias("method"), "metric", "mean", low.alias("lower"), high.alias("upper")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rounded(out, "mean", "lower", "upper")



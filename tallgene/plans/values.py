"""Queries for normalisation, transformation and binning."""

from pyspark.sql import functions as F

from tallgene.functions.rand import hash_uniform_sql
from tallgene.operators import normalise as nm
from tallgene.operators import stats as st
from tallgene.plans.bind import views
from tallgene.plans.registry import query, rounded


def v6(df):
    return rounded(df, "value")


@query("nrm_total", views("expr", "obs") + """, t AS (SELECT cell_id, sum(value) AS s FROM expr GROUP BY 1),
  m AS (SELECT median(s) AS m FROM t) SELECT cell_id, gene, round(value / s * m, 6) AS value FROM expr JOIN t USING (cell_id), m""")
def _(t):
    return v6(nm.normalize_total(t.expr))


@query("nrm_total_exclude", views("bexpr") + """, t AS (SELECT *, value / sum(value) OVER (PARTITION BY cell_id) AS sh FROM bexpr),
  hi AS (SELECT DISTINCT gene FROM t WHERE sh > 0.07),
  k AS (SELECT cell_id, sum(CASE WHEN gene IN (SELECT gene FROM hi) THEN 0 ELSE value END) AS s FROM bexpr GROUP BY 1)
  SELECT cell_id, gene, round(CASE WHEN s = 0 THEN value ELSE value / s * 10000 END, 6) AS value FROM bexpr JOIN k USING (cell_id)""")
def _(t):
    return v6(nm.normalize_total(t.bexpr, 10000, exclude_highly_expressed=True, max_fraction=0.07))


@query("nrm_scale", views("expr") + "SELECT cell_id, gene, round(value * 1.25, 6) AS value FROM expr")
def _(t):
    return v6(nm.scale_counts(t.expr, 1.25))


@query("nrm_log", views("expr") + """SELECT e.cell_id, e.gene, round(ln(1 + value) / ln(2), 6) AS value,
  round(greatest(0, ln(1 + value - 0.999999)), 6) AS value_plain FROM expr e""")
def _(t):
    e = t.expr
    plain = nm.log_transform(e.withColumn("counts", F.col("value")), add_one=False).withColumnRenamed("value", "value_plain")
    both = nm.log_transform(plain.withColumn("value", F.col("counts")), base=2).drop("counts")
    return rounded(both, "value", "value_plain")


@query("nrm_median", views("expr") + """SELECT cell_id, gene, round(value / median(value) OVER (PARTITION BY gene), 6) AS value FROM expr""")
def _(t):
    return v6(nm.median_normalize(t.expr, st.gene_median(t.expr)))


@query("nrm_median_sample", views("expr", "var") + """, m AS (SELECT gene, median(value) AS m FROM expr GROUP BY 1)
  SELECT cell_id, gene, round(value / m, 6) AS value FROM expr JOIN m USING (gene) WHERE gene IN (SELECT gene FROM var WHERE kind = 'SMALL')""")
def _(t):
    small = t.var.where("kind = 'SMALL'").select("gene")
    med = st.gene_median(t.expr).join(small, "gene", "left_semi")
    return v6(nm.median_normalize_sample(t.expr, med))


@query("nrm_log_sample", views("expr") + """SELECT cell_id, gene,
  round(ln(1 + value / (sum(value) OVER (PARTITION BY cell_id) + 1) * 10000), 6) AS value FROM expr""")
def _(t):
    return v6(nm.log_normalize_sample(t.expr))


EXONS = """exons AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS gene, l_suppkey * 20 AS s,
    l_suppkey * 20 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
  seen AS (SELECT *, max(e) OVER (PARTITION BY gene ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM exons),
  len AS (SELECT gene, sum(greatest(0, e - greatest(s, coalesce(upto, s)))) / 1000.0 AS kb FROM seen GROUP BY 1)"""


@query("nrm_tpm", views("expr")[:-1] + ", " + EXONS + """,
  rate AS (SELECT cell_id, gene, value / kb AS r FROM expr JOIN len USING (gene)),
  tpm AS (SELECT cell_id, gene, r / sum(r) OVER (PARTITION BY cell_id) * 1e6 AS value FROM rate)
  SELECT cell_id, gene, round(value, 4) AS value FROM tpm WHERE gene IN (SELECT gene FROM tpm GROUP BY 1
    HAVING count(*) FILTER (value > 100000) >= 0.0012 * (SELECT count(DISTINCT cell_id) FROM expr))""")
def _(t):
    exons = t.lineitem.select(F.col("l_partkey").cast("string").alias("gene"), (F.col("l_suppkey") * 20).alias("start"),
                      (F.col("l_suppkey") * 20 + F.col("l_quantity").cast("bigint")).alias("end"))
    return rounded(nm.tpm(t.expr, nm.exon_lengths(exons), 100000.0, 0.0012), "value", digits=4)


@query("nrm_bin_intcast", views("expr") + """SELECT cell_id, gene, CAST(least(ceil(value / 6.0), 7) AS BIGINT) AS value FROM expr""")
def _(t):
    out = nm.bin_int_cast(t.expr.withColumn("value", F.col("value") / 6), 8)
    return out.withColumn("value", F.col("value").cast("bigint"))


@query("nrm_bin_percentile", views("expr") + """, e AS (SELECT cell_id, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1.0]) AS q FROM expr GROUP BY 1)
  SELECT cell_id, gene, CAST(least(greatest(len(list_filter(q, lambda x: x <= value)), 1), 4) AS BIGINT) AS value FROM expr JOIN e USING (cell_id)""")
def _(t):
    return nm.bin_percentile(t.expr, 4)


@query("nrm_bin_value", views("expr") + f""", e AS (SELECT cell_id, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1.0]) AS q FROM expr GROUP BY 1)
  SELECT cell_id, gene, CAST(ceil({hash_uniform_sql(3, 'cell_id', 'gene')} * (len(list_filter(q, lambda x: x < value))
    - len(list_filter(q, lambda x: x <= value))) + len(list_filter(q, lambda x: x <= value))) AS BIGINT) AS value
  FROM expr JOIN e USING (cell_id)""")
def _(t):
    out = nm.bin_value(t.expr, 5, seed=3)
    return out.withColumn("value", F.col("value").cast("bigint"))


@query("nrm_guess_raw", views("expr") + """, x AS (SELECT 1 + (max(value) > 50)::INT + (avg((value = 1)::INT) > 0.4)::INT + (avg(value) < 2.5)::INT + (median(value) <= 1)::INT
    + (avg((value IN (1, 2, 3))::INT) > 0.6)::INT AS score FROM expr)
  SELECT score, score >= 4 AS is_raw FROM x""")
def _(t):
    return nm.guess_raw(t.expr, True)


@query("nrm_downcast", views("expr") + """SELECT cell_id, gene, CAST(round_even(value / 4, 0) AS BIGINT) AS rounded,
  CAST(floor(value / 4) AS BIGINT) AS floored, CAST(ceil(value / 4) AS BIGINT) AS ceiled FROM expr""")
def _(t):
    e = t.expr.withColumn("raw", F.col("value") / 4)
    for how, name in (("round", "rounded"), ("floor", "floored"), ("ceil", "ceiled")):
        e = nm.downcast(e.withColumn("value", F.col("raw")), how).withColumnRenamed("value", name)
    return e.drop("raw")


@query("nrm_zscore", views("bexpr", "bobs") + """, g AS (SELECT DISTINCT gene FROM bexpr WHERE gene < 'Brand#2'),
  d AS (SELECT cell_id, gene, coalesce(value, 0) AS value FROM bobs CROSS JOIN g LEFT JOIN bexpr USING (cell_id, gene)),
  m AS (SELECT gene, avg(value) AS mu, stddev_samp(value) AS sd FROM d GROUP BY 1)
  SELECT cell_id, gene, round(least((value - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 1.5), 6) AS value FROM d JOIN m USING (gene)""")
def _(t):
    genes = t.bexpr.where("gene < 'Brand#2'").select("gene").distinct()
    return v6(nm.zscore(t.bexpr, t.bobs, genes, max_value=1.5))


@query("nrm_perturb_extreme", views("expr", "obs") + """,
  c AS (SELECT gene, CASE WHEN max(value) > 49.5 THEN 'positive' ELSE 'negative' END AS d, max(value) AS hi, min(value) AS lo, count(*) AS n
    FROM expr WHERE gene IN ('5', '17', '100') GROUP BY 1),
  n AS (SELECT gene, CASE WHEN d = 'positive' THEN hi WHEN n < (SELECT count(*) FROM obs) THEN least(lo, 0) ELSE lo END AS value FROM c)
  SELECT * FROM expr WHERE gene NOT IN (SELECT gene FROM c)
  UNION ALL SELECT cell_id, gene, value FROM obs CROSS JOIN n WHERE value <> 0""")
def _(t):
    e = t.expr
    hit = e.where("gene in ('5', '17', '100')").groupBy("gene").agg(F.max("value").alias("m"))
    changes = hit.select("gene", F.when(F.col("m") > 49.5, "positive").otherwise("negative").alias("direction"))
    return nm.perturb_extreme(e, t.obs, changes)


@query("nrm_perturb_expr", views("bexpr") + """, m AS (SELECT gene, max(value) AS mx FROM bexpr GROUP BY 1)
  SELECT cell_id, gene, round(CASE gene WHEN 'Brand#3' THEN mx * 0.5 WHEN 'Brand#8' THEN (mx - 2) / 4 ELSE value END, 6) AS value,
  CASE WHEN gene IN ('Brand#3', 'Brand#8') THEN 1 ELSE 0 END AS perturbed FROM bexpr JOIN m USING (gene)""")
def _(t):
    return v6(nm.perturb_expression(t.bexpr, {"Brand#3": "MAX*0.5", "Brand#8": "(MAX - 2) / 4"}))


BASE = ", b AS (SELECT gene, sum(value) / (SELECT count(*) FROM bobs) AS baseline FROM bexpr GROUP BY 1)"


def baseline(t):
    return nm.gene_moments(t.bexpr, t.bobs).select("gene", F.round("mean", 6).alias("baseline"))


@query("nrm_baseline_replace", views("bexpr", "bobs")[:-1] + """, b AS (SELECT gene,
    round(sum(value) / (SELECT count(*) FROM bobs), 6) AS baseline FROM bexpr GROUP BY 1),
  d AS (SELECT cell_id, gene, coalesce(value, 0) AS v, baseline AS bl FROM bobs CROSS JOIN b LEFT JOIN bexpr USING (cell_id, gene)),
  a AS (SELECT 'absolute' AS mode, cell_id, gene, CASE WHEN abs(v - bl) < 40 THEN bl ELSE v END AS value FROM d),
  r AS (SELECT 'relative' AS mode, cell_id, gene, CASE WHEN abs(CASE WHEN bl = 0 AND v - bl < 0 THEN 0 ELSE v - bl END)
    / CASE WHEN bl = 0 THEN 0.01 ELSE bl END < 0.2 THEN bl ELSE v END AS value FROM d)
  SELECT * FROM a WHERE value <> 0 UNION ALL SELECT * FROM r WHERE value <> 0""")
def _(t):
    a = nm.replace_noise_with_baseline(t.bexpr, t.bobs, baseline(t), 40.0, absolute=True)
    b = nm.replace_noise_with_baseline(t.bexpr, t.bobs, baseline(t), 0.2, absolute=False)
    return a.withColumn("mode", F.lit("absolute")).unionByName(b.withColumn("mode", F.lit("relative")))


@query("nrm_cap_quantile", views("expr") + """, q AS (SELECT gene, quantile_cont(value, 0.9) AS c FROM expr GROUP BY 1)
  SELECT cell_id, gene, round(least(value, c), 6) AS value FROM expr JOIN q USING (gene)""")
def _(t):
    return v6(nm.cap_at_quantile(t.expr, 0.9))


@query("nrm_nonhvg_baseline", views("bexpr", "bobs") + BASE + """,
  s AS (SELECT gene, var_samp(v) / avg(v) AS dispersion FROM (SELECT gene, coalesce(value, 0) AS v FROM bobs
    CROSS JOIN (SELECT DISTINCT gene FROM bexpr) LEFT JOIN bexpr USING (cell_id, gene)) GROUP BY 1),
  flat AS (SELECT gene FROM s WHERE dispersion < (SELECT quantile_cont(dispersion, 0.7) FROM s))
  SELECT cell_id, gene, round(value, 6) AS value FROM bexpr WHERE gene NOT IN (SELECT gene FROM flat)
  UNION ALL SELECT cell_id, gene, round(baseline, 6) FROM bobs CROSS JOIN b WHERE gene IN (SELECT gene FROM flat)""")
def _(t):
    m = nm.gene_moments(t.bexpr, t.bobs)
    stats = m.select("gene", (F.col("variance") / F.col("mean")).alias("dispersion"), F.col("mean").alias("baseline"))
    return v6(nm.replace_non_hvg(t.bexpr, t.bobs, stats, 0.3))


@query("udf_default_transforms", views("expr", "var") + """,
  named AS (SELECT expr.*, symbol FROM expr JOIN var USING (gene)),
  kept AS (SELECT cell_id, gene, value FROM named JOIN (SELECT gene, row_number() OVER (PARTITION BY symbol || grp ORDER BY gene_pos) AS k FROM var) USING (gene)
    WHERE k = 1),
  n AS (SELECT cell_id, gene, ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 10000) / ln(2) AS x FROM kept),
  b AS (SELECT cell_id, gene, CAST(least(ceil(round(x, 9)), 9) AS BIGINT) AS bin FROM n),
  c AS (SELECT * FROM b WHERE cell_id IN (SELECT cell_id FROM b GROUP BY 1 HAVING sum(bin) >= 2))
  SELECT cell_id, symbol || '/' || grp AS gene, bin AS value FROM c JOIN var USING (gene)""")
def _(t):
    from tallgene.plans.steps import default_transforms

    var = t.var.withColumn("new_name", F.concat_ws("/", "symbol", "grp"))
    return default_transforms(t.expr, var)


@query("udf_default_perturbation_transforms", views("pexpr", "var") + """,
  n AS (SELECT cell_id, gene, ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 10000) / ln(2) AS x FROM pexpr)
  SELECT cell_id, gene, round(x, 6) AS value FROM n""")
def _(t):
    from tallgene.plans.steps import perturbation_transforms

    return rounded(perturbation_transforms(t.pexpr), "value")



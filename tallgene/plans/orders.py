"""Queries for windows, ranking and top-k."""

from pyspark.sql import functions as F

from tallgene.operators import windows as wn
from tallgene.plans.bind import views
from tallgene.plans.registry import query, rounded


@query("win_topk_expr", views("expr") + """SELECT * FROM (SELECT cell_id, gene, value,
  CAST(row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene) AS INTEGER) AS pos FROM expr) WHERE pos <= 3""")
def _(t):
    return wn.topk_expression(t.expr, 3)


@query("win_sort_numeric_or_text", """WITH s AS (SELECT l_orderkey AS cell_id, CAST(l_linenumber AS VARCHAR) AS gene,
    CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 2 THEN l_returnflag ELSE CAST(l_suppkey AS VARCHAR) END AS f, l_partkey FROM lineitem),
  a AS (SELECT *, bool_and(TRY_CAST(f AS DOUBLE) IS NOT NULL) OVER (PARTITION BY cell_id) AS num FROM s)
  SELECT cell_id, gene, f, l_partkey, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY CASE WHEN num THEN TRY_CAST(f AS DOUBLE) END DESC NULLS LAST,
    CASE WHEN NOT num THEN f END DESC NULLS LAST, gene, l_partkey) AS INTEGER) AS pos FROM a""")
def _(t):
    f = F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 2), F.col("l_returnflag")).otherwise(F.col("l_suppkey").cast("string"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").cast("string").alias("gene"), f.alias("f"), "l_partkey")
    keyed = rows.withColumn("gene", F.struct("gene", "l_partkey"))
    return wn.sort_numeric_or_text(keyed, "f").select("cell_id", "gene.gene", "f", "l_partkey", "pos")


@query("win_perturbed_first", views("expr", "var") + """, p AS (SELECT cell_id, gene, value, mito::INT AS perturbed FROM expr JOIN var USING (gene))
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY perturbed DESC, value DESC, gene) AS INTEGER) AS pos FROM p) WHERE pos <= 2""")
def _(t):
    rows = t.expr.join(t.var.select("gene", F.col("mito").cast("int").alias("perturbed")), "gene")
    return wn.perturbed_first(rows.select("cell_id", "gene", "value", "perturbed"), 2)


@query("win_rank_cells", views("expr") + """, t AS (SELECT cell_id, sum(value) AS total FROM expr GROUP BY 1)
  SELECT cell_id, total, row_number() OVER (ORDER BY total DESC, ('0x' || substr(md5('0|' || cell_id), 1, 8))::BIGINT, cell_id) AS rank FROM t""")
def _(t):
    totals = t.expr.groupBy("cell_id").agg(F.sum("value").alias("total"))
    return wn.rank_by_total(totals, "cell_id", "total").select("cell_id", "total", "rank")


@query("win_best_worst", views("pred") + """, g AS (SELECT gene, count(*) FILTER (label > 0) AS f, avg(abs(predicted - label)) AS e,
    avg(abs(predicted - label)) FILTER (label > 0) AS enz FROM pred GROUP BY 1),
  c AS (SELECT gene, 0.5 * (enz + e) AS a FROM g WHERE f > (SELECT quantile_cont(f, 0.7) FROM g))
  (SELECT 'best' AS kind, gene, round(a, 6) AS gene_err_avg FROM c ORDER BY round(a, 9), gene LIMIT 5)
  UNION ALL (SELECT 'worst', gene, round(a, 6) FROM c ORDER BY round(a, 9) DESC, gene LIMIT 5)""")
def _(t):
    err, nz = F.abs(F.col("predicted") - F.col("label")), F.col("label") > 0
    g = t.pred.groupBy("gene").agg(F.count_if(nz).alias("gene_nz_freq"), F.avg(err).alias("gene_err"), F.avg(F.when(nz, err)).alias("gene_err_nz"))
    return rounded(wn.best_and_worst(g, 5, 0.7), "gene_err_avg")


@query("win_islands", views("seqs") + """, c AS (SELECT chrom, unnest(regexp_extract_all(seq, 'N+|[^N]+')) AS run,
    generate_subscripts(regexp_extract_all(seq, 'N+|[^N]+'), 1) AS i FROM seqs),
  p AS (SELECT chrom, run, coalesce(sum(length(run)) OVER (PARTITION BY chrom ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM c)
  SELECT chrom, s AS start, s + length(run) AS "end" FROM p WHERE run LIKE 'N%' AND length(run) >= 30""")
def _(t):
    return wn.islands(t.tiles, "N", 30)


@query("win_avg_rank", """SELECT DISTINCT l_suppkey, l_quantity, count(*) OVER (PARTITION BY l_suppkey, l_quantity) AS n,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS avg_rank FROM lineitem""")
def _(t):
    return wn.average_ranks(t.lineitem, ["l_suppkey"], "l_quantity")


@query("win_first_transcript", """WITH g AS (SELECT p_brand AS gene, p_partkey AS line_no, CASE WHEN p_size > 20 THEN p_name END AS name, p_type AS kind FROM part)
  SELECT gene, arg_min(name, line_no) FILTER (name IS NOT NULL) AS name, arg_min(kind, line_no) AS kind FROM g GROUP BY 1""")
def _(t):
    g = t.part.select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("line_no"),
                      F.when(F.col("p_size") > 20, F.col("p_name")).alias("name"), F.col("p_type").alias("kind"))
    return wn.first_transcripts(g, ["name", "kind"])

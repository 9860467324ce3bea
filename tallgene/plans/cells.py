"""Queries for filters and projections."""

from pyspark.sql import functions as F

from tallgene.operators import filters as fl
from tallgene.operators import stats as st
from tallgene.plans.bind import views
from tallgene.plans.registry import query, r

QC_SQL = """qc AS (SELECT cell_id, sum(value) AS total_counts, count(*) AS n_genes,
  100.0 * sum(CASE WHEN mito THEN value ELSE 0 END) / sum(value) AS pct_mito
  FROM expr JOIN var USING (gene) GROUP BY cell_id)"""


def cell_qc(t):
    return st.qc_cells(t.expr, t.var).select(
        "cell_id", "total_counts", F.col("n_genes_by_counts").alias("n_genes"), F.col("pct_counts_mt").alias("pct_mito")
    )


@query("flt_cells", views("expr") + """SELECT * FROM expr WHERE cell_id IN (SELECT cell_id FROM expr GROUP BY 1
  HAVING sum(value) >= 50 AND sum(value) <= 200 AND count(*) >= 3)""")
def _(t):
    return fl.filter_cells(t.expr, min_counts=50, max_counts=200, min_genes=3)


@query("flt_genes", views("expr") + """SELECT * FROM expr WHERE gene IN (SELECT gene FROM expr GROUP BY 1
  HAVING sum(value) <= 900 AND count(*) >= 20)""")
def _(t):
    return fl.filter_genes(t.expr, max_counts=900, min_cells=20)


@query("flt_keep_genes", views("expr", "var") + """SELECT gene, cell_id, value, -gene_pos AS pos
  FROM expr JOIN var USING (gene) WHERE kind = 'PROMO'""")
def _(t):
    genes = t.var.where("kind = 'PROMO'").select("gene", (-F.col("gene_pos")).alias("pos"))
    return fl.keep_genes(t.expr, genes)


@query("flt_keep_vocab", views("expr", "var") + """SELECT expr.* FROM expr WHERE gene IN
  (SELECT gene FROM var WHERE size > 25)""")
def _(t):
    vocab = t.var.select(F.when(F.col("size") > 25, "genes").otherwise("other").alias("field"), F.col("gene").alias("token"))
    return fl.keep_vocab_genes(t.expr, vocab)


@query("flt_keep_explain_target", views("expr", "var") + """SELECT expr.* FROM expr WHERE gene IN
  (SELECT gene FROM var WHERE kind = 'SMALL' OR grp = 'Brand#3')""")
def _(t):
    return fl.keep_explanatory_and_targets(t.expr, t.var.where("kind = 'SMALL'").select("gene"),
                                           t.var.where("grp = 'Brand#3'").select("gene"))


@query("flt_limit_genes", views("expr", "var", "obs") + """SELECT cell_id, label, batch FROM obs WHERE cell_id IN
  (SELECT cell_id FROM expr WHERE gene IN (SELECT gene FROM var WHERE grp = 'Brand#7'))""")
def _(t):
    _, cells = fl.limit_to_gene_list(t.expr, t.obs, t.var.where("grp = 'Brand#7'"))
    return cells.select("cell_id", "label", "batch")


@query("flt_gene_set_keyword", views("var") + """
  SELECT 'tokenizer' AS keyword, gene FROM var WHERE size <= 40
  UNION ALL SELECT 'protein_coding', gene FROM var WHERE size <= 40 AND kind IN ('PROMO', 'LARGE')
  UNION ALL SELECT 'orthologs', gene FROM var WHERE grp = 'Brand#1'
  UNION ALL SELECT 'L1000', gene FROM var WHERE price > 1000""")
def _(t):
    v = t.var
    sets = dict(vocab=v.where("size <= 40"), protein_coding=v.where("kind IN ('PROMO', 'LARGE')"),
                orthologs=v.where("grp = 'Brand#1'"), l1000=v.where("price > 1000"))
    parts = [fl.gene_set(k, **sets).select(F.lit(k).alias("keyword"), "gene")
             for k in ("tokenizer", "protein_coding", "orthologs", "L1000")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("flt_query", views("obs") + "SELECT cell_id, label, batch FROM obs WHERE batch = 'F' AND label <> '5-LOW'")
def _(t):
    return fl.query_rows(t.obs, "batch = 'F' and label != '5-LOW'").select("cell_id", "label", "batch")


@query("flt_terms", views("obs") + "SELECT cell_id, label, batch FROM obs WHERE batch = 'O' AND label IN ('2-HIGH', '3-MEDIUM')")
def _(t):
    return fl.filter_terms(t.obs, {"batch": "O", "label": {"2-HIGH", "3-MEDIUM"}}).select("cell_id", "label", "batch")


@query("flt_split", views("obs") + "SELECT cell_id, batch AS split FROM obs WHERE batch = 'P'")
def _(t):
    return fl.limit_to_split(t.obs.select("cell_id", F.col("batch").alias("split")), "P")


@query("flt_census_criteria", """SELECT l_orderkey AS cell, l_linenumber AS line, l_suppkey AS dataset_id FROM lineitem
  WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R') AND l_suppkey IN (SELECT s_suppkey FROM supplier
  WHERE s_nationkey % 3 = 1)""")
def _(t):
    cells = t.lineitem.select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("line"),
                              F.col("l_suppkey").alias("dataset_id"), F.col("l_returnflag").alias("assay"),
                              (F.col("l_linestatus") == "F").alias("is_primary_data"))
    splits = t.supplier.select(F.col("s_suppkey").alias("dataset_id"), (F.col("s_nationkey") % 3).alias("split"))
    return fl.census_cells(cells, "scTab", splits, 1, assays=("A", "R")).select("cell", "line", "dataset_id")


@query("flt_iqr_total", views("expr", "var")[:-1] + ", " + QC_SQL + """, q AS (SELECT quantile_cont(total_counts, 0.25) q1,
  quantile_cont(total_counts, 0.75) q3 FROM qc)
  SELECT cell_id, total_counts FROM qc, q WHERE total_counts BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""")
def _(t):
    return fl.filter_total_iqr(cell_qc(t), 0.5).select("cell_id", "total_counts")


@query("flt_outliers3", views("expr", "var")[:-1] + ", " + QC_SQL + """,
  l AS (SELECT cell_id, ln(1 + total_counts) a, ln(1 + n_genes) b, ln(1 + pct_mito) c FROM qc),
  q AS (SELECT quantile_cont(a, 0.25) a1, quantile_cont(a, 0.75) a3, quantile_cont(b, 0.25) b1, quantile_cont(b, 0.75) b3,
    quantile_cont(c, 0.25) c1, quantile_cont(c, 0.75) c3 FROM l)
  SELECT cell_id, round(a, 6) AS log_total FROM l, q
  WHERE a BETWEEN a1 - 1.5 * (a3 - a1) - 1e-12 AND a3 + 1.5 * (a3 - a1) + 1e-12
    AND b BETWEEN b1 - 1.5 * (b3 - b1) - 1e-12 AND b3 + 1.5 * (b3 - b1) + 1e-12
    AND c BETWEEN c1 - 1.5 * (c3 - c1) - 1e-12 AND c3 + 1.5 * (c3 - c1) + 1e-12""")
def _(t):
    return fl.filter_outliers(cell_qc(t)).select("cell_id", r("log_total").alias("log_total"))


@query("flt_valid_perturbation", views("pobs") + """, ok AS (SELECT DISTINCT p_brand AS g FROM part WHERE p_brand <> 'Brand#5'
  AND p_partkey IN (SELECT l_partkey FROM lineitem)),
  names AS (SELECT DISTINCT perturbation FROM pobs),
  parts AS (SELECT perturbation, unnest(string_split(perturbation, '_')) AS g FROM names),
  badp AS (SELECT perturbation FROM parts WHERE g <> 'Control' AND g NOT IN (SELECT g FROM ok))
  SELECT cell_id, array_to_string(list_sort(string_split(perturbation, '_')), '_') AS perturbation FROM pobs
  WHERE perturbation NOT IN (SELECT perturbation FROM badp)""")
def _(t):
    vocab = t.part.where("p_brand <> 'Brand#5'").select(F.col("p_brand").alias("gene")).distinct()
    return fl.valid_perturbations(t.pobs, vocab, t.pexpr.select("gene")).select("cell_id", "perturbation")


@query("flt_variant_keyword", """SELECT event_id, props FROM events WHERE contains(props, '"k": 6')""")
def _(t):
    return fl.variants_with_keyword(t.events, '"k": 6', "props").select("event_id", "props")


@query("flt_all_n_chunk", views("seqs") + """, c AS (SELECT chrom, substr(seq, i * 16 + 1, 16) AS seq, i AS chunk
  FROM seqs, LATERAL (SELECT unnest(range(0, (length(seq) + 15) // 16)) AS i))
  SELECT chrom, chunk, seq FROM c WHERE NOT regexp_matches(seq, '^N+$')""")
def _(t):
    from tallgene.operators.sequence import chunk_tiles

    return fl.drop_all_n(chunk_tiles(t.tiles, 16, drop_n=False))


@query("prj_move_targets", views("bexpr", "bobs") + """SELECT cell_id, label,
  coalesce(sum(value) FILTER (gene = 'Brand#3'), 0) AS "Brand#3", coalesce(sum(value) FILTER (gene = 'Brand#9'), 0) AS "Brand#9",
  coalesce(sum(value) FILTER (gene NOT IN ('Brand#3', 'Brand#9')), 0) AS rest
  FROM bobs LEFT JOIN bexpr USING (cell_id) GROUP BY 1, 2""")
def _(t):
    rest, obs = fl.move_targets_to_labels(t.bexpr, t.bobs, ["Brand#3", "Brand#9"])
    totals = rest.groupBy("cell_id").agg(F.sum("value").alias("rest"))
    return obs.join(totals, "cell_id", "left").fillna(0.0).select("cell_id", "label", "Brand#3", "Brand#9", "rest")


@query("prj_rename_cols", "SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer")
def _(t):
    return fl.rename_columns(t.customer, "name$|segment", "c_")


@query("prj_layer", """SELECT CAST(l_orderkey AS VARCHAR) AS cell_id, CAST(l_partkey AS VARCHAR) AS gene,
  l_extendedprice AS value FROM lineitem""")
def _(t):
    layers = t.lineitem.select(F.col("l_orderkey").cast("string").alias("cell_id"),
                               F.col("l_partkey").cast("string").alias("gene"),
                               F.col("l_quantity").alias("counts"), F.col("l_extendedprice").alias("price"))
    return fl.use_layer(layers, "price")


@query("prj_dense_row", views("bexpr", "bobs") + """SELECT cell_id, gene, coalesce(value, 0) AS value
  FROM bobs CROSS JOIN (SELECT DISTINCT p_brand AS gene FROM part) LEFT JOIN bexpr USING (cell_id, gene)""")
def _(t):
    return fl.dense_rows(t.bexpr, t.bobs, t.part.select(F.col("p_brand").alias("gene"))).select("cell_id", "gene", "value")


@query("prj_order_genes", views("expr", "var") + """SELECT cell_id,
  array_to_string(list(gene ORDER BY price DESC, gene), ',') AS genes,
  array_to_string(list(CAST(value AS BIGINT) ORDER BY price DESC, gene), ',') AS vals
  FROM expr JOIN var USING (gene) GROUP BY 1""")
def _(t):
    out = fl.order_genes(t.expr, t.var, "price")
    return out.select("cell_id", F.array_join("genes", ",").alias("genes"),
                      F.array_join(F.col("values").cast("array<bigint>").cast("array<string>"), ",").alias("vals"))


@query("prj_ensembl_check", """SELECT count(*) FILTER (regexp_matches(g, '^(ENSG|ENSMUSG)')) > 8 AS is_ensembl,
  count(*) FILTER (regexp_matches(g, '^(ENSG|ENSMUSG)')) AS n_match
  FROM (SELECT CASE WHEN p_partkey % 16 = 5 THEN p_name ELSE 'ENSG' || p_partkey END AS g FROM part ORDER BY p_partkey LIMIT 10)""")
def _(t):
    named = t.var.withColumn("gene", F.when(F.col("gene_pos") % 16 == 5, F.col("symbol")).otherwise(F.concat(F.lit("ENSG"), "gene")))
    return fl.ensembl_check(named)


@query("flt_any_column_contains", "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%large%' OR lower(p_type) LIKE '%large%'")
def _(t):
    return fl.any_column_contains(t.part.select("p_partkey", "p_name", "p_type"), "Large")


@query("flt_group_having", """WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10
  GROUP BY 1 HAVING count(*) > 150)
  SELECT DISTINCT l_suppkey, l_linestatus, n FROM lineitem JOIN g USING (l_suppkey) WHERE l_returnflag = 'R' AND l_quantity > 10""")
def _(t):
    return fl.groups_over(t.lineitem, "l_returnflag = 'R' and l_quantity > 10", ["l_suppkey"], 150, ["l_linestatus"])

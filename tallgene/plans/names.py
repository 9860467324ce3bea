"""Queries for gene-name and label harmonisation."""

from pyspark.sql import functions as F

from tallgene.operators import harmonise as hz
from tallgene.operators import stats as st
from tallgene.plans.bind import views
from tallgene.plans.registry import query, rounded


def ensg_var(t):
    return t.var.withColumn("gene", F.concat(F.col("symbol"), F.lit("_ENSG"), F.col("gene")))


@query("jn_rename_genes", views("expr", "var") + """, k AS (SELECT gene, symbol AS nn FROM var QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY gene_pos) = 1)
  SELECT cell_id, nn AS gene, value FROM expr JOIN k USING (gene)""")
def _(t):
    v = ensg_var(t)
    e = t.expr.join(t.var.select("gene", "symbol"), "gene").select(
        "cell_id", F.concat(F.col("symbol"), F.lit("_ENSG"), F.col("gene")).alias("gene"), "value")
    return hz.rename_genes(e, v)


@query("jn_rename_genes_map", views("expr", "var") + """, m AS (SELECT gene, gene_pos, CASE WHEN kind <> 'SMALL' THEN symbol || grp END AS nn FROM var),
  k AS (SELECT gene, nn FROM m QUALIFY row_number() OVER (PARTITION BY nn ORDER BY gene_pos) = 1)
  SELECT cell_id, nn AS gene, value FROM expr JOIN k USING (gene)""")
def _(t):
    gmap = t.var.where("kind <> 'SMALL'").select("gene", F.concat("symbol", "grp").alias("new_name"))
    return hz.rename_genes(t.expr, t.var, gmap)


STD = """, m AS (SELECT gene, gene_pos, symbol || grp AS nn FROM var WHERE size <= 30),
  k AS (SELECT gene, nn, row_number() OVER (PARTITION BY nn ORDER BY gene_pos) AS k FROM m)"""


@query("jn_standardize_genes", views("expr", "var") + STD + """
  SELECT 'remove' AS strategy, cell_id, nn AS gene, value FROM expr JOIN k USING (gene) WHERE k = 1
  UNION ALL SELECT 'rename', cell_id, CASE WHEN k > 1 THEN nn || '_' || (k - 1) ELSE nn END, value FROM expr JOIN k USING (gene)
  UNION ALL SELECT 'aggregate', cell_id, nn, sum(value) FROM expr JOIN k USING (gene) GROUP BY ALL""")
def _(t):
    gmap = t.var.where("size <= 30").select(F.col("gene").alias("name"), F.concat("symbol", "grp").alias("symbol"))
    out = None
    for s in ("remove", "rename", "aggregate"):
        one = hz.standardize_genes(t.expr, t.var, gmap, s).select(F.lit(s).alias("strategy"), "cell_id", "gene", "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("jn_standardize_genes_unmatched", views("expr", "var") + "SELECT cell_id, gene, value FROM expr JOIN var USING (gene)")
def _(t):
    gmap = t.var.select(F.when(F.col("size") <= 5, F.col("gene")).otherwise(F.concat(F.lit("x"), "gene")).alias("name"),
                        F.col("symbol"))
    return hz.standardize_genes(t.expr, t.var, gmap)


def nomenclature(t):
    """Gene table with aliases and previous symbols made from neighbouring names."""
    p = t.part
    return p.select(
        F.col("p_partkey").alias("row"), F.concat("p_name", F.lit("/"), "p_size").alias("symbol"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("|", F.concat("p_name", F.lit("/"), (F.col("p_size") % 7).cast("string")), "p_brand"))
        .alias("alias_symbol"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.col("p_type"), F.lit("|"), F.concat("p_name", F.lit("/1")))).alias("prev_symbol"),
    )


NOMEN = """WITH src AS (SELECT p_partkey AS rw, p_name || '/' || p_size AS symbol,
    CASE WHEN p_partkey % 3 = 0 THEN p_name || '/' || (p_size % 7) || '|' || p_brand END AS al,
    CASE WHEN p_partkey % 4 = 0 THEN p_type || '|' || p_name || '/1' END AS pr FROM part),
  ent AS (SELECT symbol AS name, symbol, rw, 0 AS prio, 0 AS ps FROM src
    UNION ALL SELECT unnest(string_split(al, '|')), symbol, rw, 1, generate_subscripts(string_split(al, '|'), 1) FROM src WHERE al IS NOT NULL
    UNION ALL SELECT unnest(string_split(pr, '|')), symbol, rw, 2, generate_subscripts(string_split(pr, '|'), 1) FROM src WHERE pr IS NOT NULL)"""


@query("jn_gene_map_build", NOMEN + """SELECT name, arg_min(symbol, (rw, prio, ps)) AS symbol FROM ent GROUP BY 1""")
def _(t):
    return hz.build_gene_map(nomenclature(t))


@query("jn_gene_map_ambiguity", NOMEN + """, a AS (SELECT name, count(*) AS k, bit_or(1 << prio) AS m FROM ent GROUP BY 1)
  SELECT 'entries' AS kind, k AS key, count(*) AS n_names FROM a GROUP BY ALL
  UNION ALL SELECT 'sets', CAST(m AS BIGINT), count(*) FROM a GROUP BY ALL""")
def _(t):
    return hz.gene_map_ambiguity(nomenclature(t))


@query("jn_orthologs", views("expr", "var") + """, o AS (SELECT gene, symbol || '.' || gene AS ortholog FROM var WHERE size % 2 = 1 AND kind <> 'LARGE' AND grp <> 'Brand#2')
  SELECT cell_id, gene, value, ortholog FROM expr LEFT JOIN o USING (gene)""")
def _(t):
    raw = t.var.select(
        "gene", F.when(F.col("grp") != "Brand#2", F.concat_ws(".", "symbol", "gene")).alias("ortholog"),
        (F.col("size") % 2).alias("confidence"),
        F.when(F.col("kind") == "LARGE", "ortholog_one2many").otherwise("ortholog_one2one").alias("type"))
    return hz.map_orthologs(t.expr, hz.ortholog_table(raw)).select("cell_id", "gene", "value", "ortholog")


@query("jn_locations", views("var") + """SELECT gene, CASE WHEN kind <> 'PROMO' THEN 'c' || (gene_pos % 25) END AS chromosome,
  CASE WHEN kind <> 'PROMO' THEN gene_pos * 50 END AS start FROM var""")
def _(t):
    loc = t.var.where("kind <> 'PROMO'").select(
        "gene", F.concat(F.lit("c"), (F.col("gene_pos") % 25).cast("string")).alias("chromosome"), (F.col("gene_pos") * 50).alias("start"))
    return hz.add_locations(t.var.select("gene"), loc)


@query("jn_medians_symbol", views("expr", "var") + """, m AS (SELECT gene, median(value) AS m FROM expr GROUP BY 1)
  SELECT symbol, max(m) AS median_max, sum(m) AS median_sum FROM m JOIN var USING (gene) GROUP BY 1""")
def _(t):
    med, names = st.gene_median(t.expr), t.var.select("gene", "symbol")
    a = hz.symbol_medians(med, names, "max").withColumnRenamed("median", "median_max")
    return a.join(hz.symbol_medians(med, names, "sum").withColumnRenamed("median", "median_sum"), "symbol")


@query("jn_metadata", views("obs") + "SELECT cell_id, label, c_mktsegment AS segment FROM obs LEFT JOIN customer ON donor = CAST(c_custkey AS VARCHAR)")
def _(t):
    meta = t.customer.select(F.col("c_custkey").cast("string").alias("donor"), F.col("c_mktsegment").alias("segment"))
    return hz.merge_metadata(t.obs, meta, "donor").select("cell_id", "label", "segment")


@query("jn_extra_mapping", views("obs") + """SELECT cell_id, label, CASE WHEN label <> '5-LOW' THEN 'CL:' || substr(label, 1, 1) END AS term FROM obs""")
def _(t):
    labels = t.orders.select(F.col("o_orderpriority").alias("value")).where("value <> '5-LOW'").distinct()
    mapping = labels.withColumn("term", F.concat(F.lit("CL:"), F.substring("value", 1, 1)))
    return hz.extra_mapping(t.obs, mapping, "label", "term").select("cell_id", "label", "term")


@query("jn_recode_fill", views("obs") + """SELECT cell_id, label, CASE WHEN label IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE label END AS new_label FROM obs""")
def _(t):
    mapping = t.orders.select(F.col("o_orderpriority").alias("value")).where("value in ('1-URGENT', '2-HIGH')").distinct()
    return hz.recode(t.obs, mapping.withColumn("new", F.lit("fast")), "label", "new_label").select("cell_id", "label", "new_label")


RAWPERT = """SELECT o_orderkey AS cell, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'G' || (o_custkey % 9) || '+ctrl'
  WHEN 2 THEN 'ctrl+G' || (o_custkey % 9) WHEN 3 THEN 'G' || (o_custkey % 9) || '+G' || (o_custkey % 4) ELSE 'ctrl' END AS p FROM orders"""


def _raw_pert(t):
    c, g = F.col("o_custkey"), F.concat(F.lit("G"), (F.col("o_custkey") % 9).cast("string"))
    p = (F.when(c % 5 == 1, F.concat(g, F.lit("+ctrl"))).when(c % 5 == 2, F.concat(F.lit("ctrl+"), g))
         .when(c % 5 == 3, F.concat(g, F.lit("+G"), (c % 4).cast("string"))).when(c % 5 == 4, "ctrl"))
    return t.orders.select(F.col("o_orderkey").alias("cell"), p.alias("perturbation"))


@query("jn_pert_names_gears", f"""WITH r AS ({RAWPERT})
  SELECT cell, replace(replace(replace(replace(p, '+ctrl', ''), 'ctrl+', ''), '+', '_'), 'ctrl', 'Control') AS perturbation FROM r WHERE p IS NOT NULL""")
def _(t):
    return hz.clean_plus_names(_raw_pert(t))


@query("jn_pert_names_scperturb", """WITH r AS (SELECT o_orderkey AS cell, CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'G' || (o_custkey % 9) || '(mod)_g1'
  WHEN 2 THEN 'G' || (o_custkey % 9) || '_only_g2' WHEN 3 THEN '*_x' WHEN 4 THEN '62(ctrl_3' ELSE 'G' || (o_custkey % 9) || '_G1_p' END AS p FROM orders),
  s AS (SELECT cell, replace(regexp_replace(regexp_replace(regexp_replace(p, '_[^_]*$', ''), '.+\\(mod\\)', 'Control'), '.+ctrl', 'Control'), '_only', '') AS perturbation
    FROM r WHERE p IS NOT NULL)
  SELECT * FROM s WHERE perturbation <> '*'""")
def _(t):
    c, g = F.col("o_custkey"), F.concat(F.lit("G"), (F.col("o_custkey") % 9).cast("string"))
    p = (F.when(c % 6 == 1, F.concat(g, F.lit("(mod)_g1"))).when(c % 6 == 2, F.concat(g, F.lit("_only_g2")))
         .when(c % 6 == 3, "*_x").when(c % 6 == 4, "62(ctrl_3").when(c % 6 == 5, F.concat(g, F.lit("_G1_p"))))
    return hz.clean_guide_names(t.orders.select(F.col("o_orderkey").alias("cell"), p.alias("perturbation")))


@query("jn_pert_names_replogle", views("var") + """SELECT gene, CASE WHEN k = 1 THEN symbol ELSE symbol || '-' || (k - 1) END AS gene_name,
  CASE WHEN kind = 'PROMO' THEN 'Control' ELSE kind END AS perturbation
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY gene_pos) AS k FROM var)""")
def _(t):
    v = hz.unique_names(t.var, "symbol", "gene_name").withColumnRenamed("kind", "perturbation")
    return hz.clean_targeting_names(v, control="PROMO").select("gene", "gene_name", "perturbation")


@query("jn_reindex_tiebreak", views("expr", "var") + """, m AS (SELECT gene, sum(value) AS mean FROM expr GROUP BY 1)
  SELECT symbol, gene, mean FROM var JOIN m USING (gene) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY mean DESC, gene_pos) = 1""")
def _(t):
    m = t.expr.groupBy("gene").agg(F.sum("value").alias("mean"))
    return hz.reindex_by_best(t.var.join(m, "gene"), "symbol", "mean").select("symbol", "gene", "mean")


@query("jn_label_dict", views("obs") + """SELECT label_column, label, CAST(row_number() OVER (PARTITION BY label_column ORDER BY label) - 1 AS INTEGER) AS label_id
  FROM (SELECT DISTINCT 'label' AS label_column, label FROM obs UNION ALL SELECT DISTINCT 'batch', batch FROM obs)""")
def _(t):
    return hz.label_dictionary(t.obs, ["label", "batch"])


@query("jn_label_decode", """SELECT l_orderkey, l_linenumber, l_returnflag AS name FROM lineitem""")
def _(t):
    d = hz.label_dictionary(t.lineitem, ["l_returnflag"])
    flag = F.col("l_returnflag")
    pred = t.lineitem.select("l_orderkey", "l_linenumber", F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("pid"))
    return hz.decode_labels(pred, d, "pid", "name").select("l_orderkey", "l_linenumber", "name")


@query("jn_embed_align", """SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def _(t):
    out = hz.align_embeddings(t.emb.select("vec_id"), t.emb.select("vec_id", "vec"), "vec_id")
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("vec_id", total.alias("total")), "total")


@query("jn_embed_concat", """SELECT vec_id, 128 AS dims, round(embedding[1]::DOUBLE, 6) AS first_value, round(embedding[64]::DOUBLE * 2, 6) AS last_value
  FROM embeddings WHERE label > 1 AND label < 8""")
def _(t):
    a = t.emb.where("label > 1")
    b = t.emb.where("label < 8").select("vec_id", F.transform("vec", lambda x: x * 2).alias("vec"))
    out = hz.concat_embeddings(a, b, "vec_id")
    return rounded(out.select("vec_id", F.size("vec").alias("dims"), F.col("vec")[0].alias("first_value"), F.col("vec")[127].alias("last_value")),
                   "first_value", "last_value")


@query("jn_merge_results", views("obs") + """SELECT o.cell_id, o.label, o.batch, r.label AS label_model, r.score2 FROM obs o LEFT JOIN
  (SELECT CAST(l_orderkey AS VARCHAR) AS cell_id, min(l_returnflag) AS label, sum(l_linenumber)::BIGINT AS score2 FROM lineitem GROUP BY 1) r
  USING (cell_id)""")
def _(t):
    res = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("cell_id")).agg(
        F.min("l_returnflag").alias("label"), F.sum("l_linenumber").alias("score2"))
    return hz.merge_results(t.obs.select("cell_id", "label", "batch"), res, "cell_id")

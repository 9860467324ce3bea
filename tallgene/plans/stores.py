"""Queries for sources, sinks, streams and user functions.

Text and stream queries first export the given tables to the shared folder, then read the export back.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallgene.functions.lineage import scratch_path
from tallgene.operators import harmonise as hz
from tallgene.operators import samples as sm
from tallgene.operators import user as us
from tallgene.plans import steps
from tallgene.plans.bind import views
from tallgene.plans.genome import chunk_cte
from tallgene.plans.registry import query, rounded
from tallgene.sources import io
from tallgene.streaming import jobs


@query("src_expr_parquet", """SELECT CAST(l_orderkey AS VARCHAR) AS cell_id, CAST(l_partkey AS VARCHAR) AS gene, l_discount AS value FROM lineitem WHERE l_discount <> 0""")
def _(t):
    return io.read_expression(t.spark, f"{t.sf_dir}/lineitem.parquet", "l_orderkey", "l_partkey", "l_discount")


@query("src_10x_text", views("expr", "var") + "SELECT cell_id, gene, value, symbol, 'Gene Expression' AS feature_type FROM expr JOIN var USING (gene)")
def _(t):
    folder = scratch_path(t.spark, "tenx")
    io.write_10x(t.expr, t.var, folder)
    expr, features = io.read_10x(t.spark, folder)
    return expr.join(features, "gene").select("cell_id", "gene", "value", "symbol", "feature_type")


@query("src_meta_csv", """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS segment, c_nationkey AS study FROM customer""")
def _(t):
    path = scratch_path(t.spark, "meta")
    seg = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    t.customer.select("c_custkey", seg.alias("s"), "c_nationkey").write.option("nullValue", "\\N").csv(path)
    return io.read_meta_csv(t.spark, path, "id bigint, segment string, study int")


@query("src_fasta", views("seqs")[:-1] + ", " + chunk_cte("c", 500) + " SELECT chrom, chunk AS tile, chunk * 500 AS start, seq FROM c")
def _(t):
    path = scratch_path(t.spark, "fasta")
    io.write_lines(io.fasta_lines(t.tiles, 64), path, "chrom", "at")
    return io.read_fasta(t.spark, path, 500)




@query("src_vcf_text", """SELECT 'NC_' || user_id % 5 AS contig, event_id AS pos, 'rs' || event_id AS id, 'A' AS ref, 'C,G' AS alt, 2 AS n_alts, CAST(user_id AS VARCHAR) AS rs FROM events WHERE event_type = 'click'""")
def _(t):
    path = scratch_path(t.spark, "vcf")
    info = F.concat(F.lit("RS="), F.col("user_id").cast("string"), F.lit(";FREQ=S:0.9,0.1"), F.when(F.col("event_type") == "click", ";COMMON").otherwise(""))
    lines = F.concat_ws("\t", F.concat(F.lit("NC_"), (F.col("user_id") % 5).cast("string")), F.col("event_id").cast("string"),
                        F.concat(F.lit("rs"), F.col("event_id").cast("string")), F.lit("A"), F.lit("C,G"), F.lit("."), F.lit("."), info)
    head = t.events.select(F.lit("##fileformat=VCFv4.2;COMMON").alias("value")).distinct()
    t.events.select(lines.alias("value")).unionByName(head).write.text(path)
    out = io.read_vcf(t.spark, path)
    return out.select("contig", "pos", "id", "ref", "alt", F.size("alts").alias("n_alts"), F.col("info_map")["RS"].alias("rs"))


@query("src_gtf", """SELECT 'chr' || p_size % 5 AS chrom, p_partkey AS start, p_partkey + p_size AS "end", CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_name AS gene_name FROM part WHERE p_type <> 'SMALL' AND p_type <> 'LARGE'""")
def _(t):
    path = scratch_path(t.spark, "gtf")
    named = F.when(F.col("p_type") == "LARGE", "").otherwise(F.concat(F.lit(' gene_name "'), "p_name", F.lit('";')))
    lines = F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("p_size") % 5).cast("string")), F.lit("src"), F.when(F.col("p_type") == "SMALL", "exon").otherwise("transcript"),
                        F.col("p_partkey").cast("string"), (F.col("p_partkey") + F.col("p_size")).cast("string"), F.lit("."),
                        F.when(F.col("p_size") % 2 == 0, "+").otherwise("-"), F.lit("."), F.concat(F.lit('gene_id "g";'), named))
    head = t.part.select(F.lit("#!genome-build test").alias("value")).distinct()
    t.part.select(lines.alias("value")).unionByName(head).write.text(path)
    return io.read_gtf(t.spark, path).select("chrom", "start", "end", "strand", "gene_name")


@query("src_dna_csv", views("seqs") + """SELECT seq AS sequence, CAST(n_chars AS VARCHAR) AS label, lang AS split FROM documents JOIN seqs ON chrom = 'd' || doc_id WHERE length(seq) > 0""")
def _(t):
    folder = scratch_path(t.spark, "dna")
    rows = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), "n_chars", "lang").join(t.seqs, "chrom").where(F.length("seq") > 0)
    # Files are named by the language's bytes in hex: null, empty names and slashes are no file names.
    name = F.coalesce(F.concat(F.lit("x"), F.lower(F.hex(F.encode("lang", "UTF-8")))), F.lit("null"))
    io.write_dna_csv(rows.select(F.col("seq").alias("dna"), F.col("n_chars").alias("label"), name.alias("split")), folder)
    lang = F.when(F.col("split") != "null", F.decode(F.unhex(F.substr("split", F.lit(2))), "UTF-8"))
    return io.read_dna_csv(t.spark, folder).select("sequence", "label", lang.alias("split"))


@query("src_fileset", views("expr", "obs") + """, x AS (SELECT expr.*, batch AS dataset FROM expr JOIN obs USING (cell_id)), g AS (SELECT gene FROM x GROUP BY 1 HAVING count(DISTINCT dataset) = 3)
  SELECT x.cell_id, gene, value, dataset, CASE WHEN dataset <> 'P' THEN label END AS label FROM x JOIN obs USING (cell_id) WHERE gene IN (SELECT gene FROM g)""")
def _(t):
    parts = {}
    for (b,) in sorted(map(tuple, t.obs.select("batch").distinct().collect())):
        cells = t.obs.where(F.col("batch") == b).select("cell_id", "label")
        expr = t.expr.join(cells.select("cell_id"), "cell_id", "left_semi")
        parts[b] = (expr, cells if b != "P" else cells.drop("label"))
    expr, obs = io.read_fileset(parts, "outer")
    return expr.join(obs.drop("dataset"), "cell_id").select("cell_id", "gene", "value", "dataset", "label")


CLASSES = ["A", "N", "R"]


def results(t):
    a, n, r = F.col("logit_a"), F.col("logit_n"), F.col("logit_r")
    best = F.when((a >= n) & (a >= r), 0).when(n >= r, 1).otherwise(2)
    rows = t.cpred.select(F.col("sample_id").alias("cell_id"), F.array(a, n).alias("embedding"), best.alias("predicted_id"), F.array(a, n, r).alias("logits"))
    return io.result_tables(rows, hz.label_dictionary(t.lineitem, ["l_returnflag"]), CLASSES)


RES = views("cpred") + """SELECT sample_id AS cell_id, predicted AS prediction, round(logit_a, 6) AS logit_a, round(exp(logit_r) / (exp(logit_a) + exp(logit_n) + exp(logit_r)), 6) AS prob_r, round(logit_n, 6) AS e1 FROM cpred"""


@query("snk_results", RES)
def _(t):
    k = results(t)
    out = k["predictions"].join(k["logits"].select("cell_id", F.col("A").alias("logit_a")), "cell_id").join(
        k["probabilities"].select("cell_id", F.col("R").alias("prob_r")), "cell_id").join(k["embeddings"], "cell_id")
    return rounded(out.select("cell_id", "prediction", "logit_a", "prob_r", F.col("embedding")[1].alias("e1")), "logit_a", "prob_r", "e1")


@query("src_pred_csv", RES)
def _(t):
    folder = scratch_path(t.spark, "pred")
    io.write_results(results(t), folder)
    out = io.read_predictions(t.spark, folder, 2, CLASSES)
    return rounded(out.select("cell_id", "prediction", F.col("logits")[0].alias("logit_a"), F.col("probabilities")[2].alias("prob_r"), F.col("embedding")[1].alias("e1")),
                   "logit_a", "prob_r", "e1")


@query("snk_parquet_split", views("obs") + "SELECT batch AS split, label, count(*) AS n FROM obs GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "split")
    io.write_split(t.obs.withColumnRenamed("batch", "split"), path)
    return t.spark.read.parquet(path).groupBy("split", "label").agg(F.count("*").alias("n"))


@query("snk_chunk_index", """WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events)
  SELECT event_id, position, CAST(position // 300 AS BIGINT) AS chunk, position % 300 AS place FROM p""")
def _(t):
    return io.chunk_index(t.events.select("event_id"), "event_id", 300)


@query("snk_chunk_manifest", """WITH p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS position FROM events)
  SELECT CAST(position // 300 AS BIGINT) AS chunk, count(*) AS chunk_size, 'chunk_index' || lpad(CAST(position // 300 AS VARCHAR), 8, '0') || '.bin' AS filename FROM p GROUP BY ALL""")
def _(t):
    return io.chunk_manifest(io.chunk_index(t.events.select("event_id"), "event_id", 300))


# streams ---------------------------------------------------------------------------------------------

@query("stm_ingest_qc", views("expr", "var") + """SELECT cell_id, sum(value) AS total_counts, count(*) AS n_genes_by_counts, sum(CASE WHEN mito THEN value ELSE 0 END) AS total_counts_mt,
  round(100 * sum(CASE WHEN mito THEN value ELSE 0 END) / sum(value), 6) AS pct_counts_mt FROM expr JOIN var USING (gene) GROUP BY 1""")
def _(t):
    root = scratch_path(t.spark, "ingest")
    t.expr.repartition(6, "cell_id", "gene").write.parquet(f"{root}/shards")
    out = jobs.ingest_qc(t.spark, f"{root}/shards", "cell_id string, gene string, value double", t.var, f"{root}/qc", f"{root}/ckpt", 3)
    return rounded(out, "pct_counts_mt")


STORE = """WITH o AS (SELECT CAST(p_partkey AS VARCHAR) AS gene_symbol, r_name AS biosample_name, p_retailprice AS price FROM part CROSS JOIN region WHERE p_type <> 'SMALL'),
  n AS (SELECT CAST(p_partkey AS VARCHAR) AS gene_symbol, 'ASIA' AS biosample_name, CASE WHEN p_size > 10 THEN p_retailprice * 2 END AS price, p_size AS size FROM part)
  SELECT gene_symbol, biosample_name, coalesce(n.price, o.price) AS price, size FROM o FULL JOIN n USING (gene_symbol, biosample_name)"""


def store_parts(t):
    names = t.region.select(F.collect_list("r_name")).scalar()
    gene = F.col("p_partkey").cast("string").alias("gene_symbol")
    old = t.part.where("p_type <> 'SMALL'").select(gene, F.explode(names).alias("biosample_name"), F.col("p_retailprice").alias("price"))
    new = t.part.select(gene, F.lit("ASIA").alias("biosample_name"), F.when(F.col("p_size") > 10, F.col("p_retailprice") * 2).alias("price"), F.col("p_size").alias("size"))
    return old, new


@query("stm_datastore_upsert", STORE)
def _(t):
    return jobs.upsert(*store_parts(t))


@query("stm_datastore_stream", STORE)
def _(t):
    root = scratch_path(t.spark, "store")
    old, new = store_parts(t)
    both = "gene_symbol string, biosample_name string, price double, size int"
    old.withColumn("size", F.lit(None).cast("int")).write.parquet(f"{root}/in/a")
    jobs.datastore_stream(t.spark, f"{root}/in/*", both, f"{root}/store", f"{root}/ckpt")
    new.write.parquet(f"{root}/in/b")
    return jobs.datastore_stream(t.spark, f"{root}/in/*", both, f"{root}/store", f"{root}/ckpt")


@query("stm_gene_error_running", views("pred") + "SELECT gene, round(sum(abs(predicted - label)), 4) AS err_sum, count(*) AS n, round(avg(abs(predicted - label)), 6) AS gene_err FROM pred GROUP BY 1")
def _(t):
    root = scratch_path(t.spark, "errors")
    t.pred.repartition(5).write.parquet(f"{root}/in")
    out = jobs.running_gene_errors(t.spark, f"{root}/in", "sample_id string, gene string, label double, predicted double, logit_zero double", f"{root}/out", f"{root}/ckpt")
    return rounded(rounded(out, "err_sum", digits=4), "gene_err")


# user functions ------------------------------------------------------------------------------------------

@query("udf_transform_registry", views("expr") + """, n AS (SELECT cell_id, gene, value / sum(value) OVER (PARTITION BY cell_id) * 100 AS v FROM expr)
  SELECT cell_id, gene, CAST(least(ceil(round(v, 9)), 49) AS BIGINT) AS value FROM n""")
def _(t):
    steps.register_transform("round9", lambda df: df.withColumn("value", F.round("value", 9)))
    out = steps.compose(t.expr, [("normalize_total", {"target_sum": 100}), ("round9", {}), ("bin_int_cast", {"num_bins": 50})])
    return out.withColumn("value", F.col("value").cast("bigint"))


@query("udf_output_wrapper", views("expr") + "SELECT cell_id, max(value) - min(value) AS output FROM expr GROUP BY 1")
def _(t):
    def spread(items):
        values = items.getField("value")
        return F.array_max(values) - F.array_min(values)

    return us.wrap_output(sm.build_samples(t.expr), spread).select("cell_id", "output")


@query("udf_batch_score", views("expr") + """SELECT cell_id, round(sum(ln(1 + value)), 5) AS embedding0, round(count(*)::DOUBLE, 5) AS embedding1, CASE WHEN sum(ln(1 + value)) > 12 THEN 'high' ELSE 'low' END AS prediction FROM expr GROUP BY 1""")
def _(t):
    def score(cells: pd.DataFrame) -> pd.DataFrame:
        total = np.array([np.log1p(np.asarray(v, dtype=float)).sum() for v in cells["values"]])
        return pd.DataFrame({"cell_id": cells["cell_id"].to_numpy(), "embedding0": total, "embedding1": [float(len(v)) for v in cells["values"]],
                             "prediction": np.where(total > 12, "high", "low")})

    out = us.score_batches(sm.build_samples(t.expr), score, "cell_id string, embedding0 double, embedding1 double, prediction string")
    return rounded(out, "embedding0", "embedding1", digits=5)

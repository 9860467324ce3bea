"""Queries for set operations, concatenation and vocabularies."""

from pyspark.sql import functions as F

from tallgene.operators import setops as so
from tallgene.plans.bind import views
from tallgene.plans.registry import query


def by_batch(t):
    cells = t.obs.select("cell_id", "batch")
    e = t.expr.join(cells.hint("shuffle_hash"), "cell_id")  # the entries of a cell need no sort
    names = sorted(r[0] for r in cells.select("batch").distinct().collect())
    return {b: e.where(F.col("batch") == b).drop("batch") for b in names}


@query("set_concat_outer", views("expr", "obs") + "SELECT cell_id, gene, value, batch FROM expr JOIN obs USING (cell_id)")
def _(t):
    return so.concat_outer(by_batch(t))


@query("set_concat_inner", views("expr", "obs") + """, x AS (SELECT * FROM expr JOIN obs USING (cell_id))
  SELECT gene, cell_id, value, batch FROM x WHERE gene IN (SELECT gene FROM x GROUP BY 1 HAVING count(DISTINCT batch) = 3)""")
def _(t):
    return so.concat_inner(by_batch(t))


@query("set_unique_cells", """SELECT event_id, event_type || '_' || user_id || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS cell_name
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS k FROM events)""")
def _(t):
    return so.unique_cells(t.events.select("event_id", "event_type", "user_id"), "event_type", "user_id", "event_id").select("event_id", "cell_name")


@query("set_vocab_union", """SELECT gene, CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS pos FROM
  (SELECT p_name AS gene FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part)""")
def _(t):
    return so.vocab_union([t.part.select(F.col(c).alias("gene")) for c in ("p_name", "p_type", "p_brand")])


VOCAB = """toks AS (SELECT 0 AS f, 'genes' AS field, 0 AS prio, i AS pos, tok AS token FROM
    (SELECT unnest(['[UNK]', '[SEP]', '[PAD]', '[CLS]', '[MASK]']) AS tok, unnest([0, 1, 2, 3, 4]) AS i)
  UNION ALL SELECT 0, 'genes', 1, p_partkey, 'g' || p_partkey FROM part
  UNION ALL SELECT 1, 'expressions', 0, i, tok FROM (SELECT unnest(['[UNK]', '[SEP]', '[PAD]', '[CLS]', '[MASK]']) AS tok, unnest([0, 1, 2, 3, 4]) AS i)
  UNION ALL SELECT 1, 'expressions', 1, i, CAST(i AS VARCHAR) FROM range(10) r(i)),
  vocab AS (SELECT field, token, CAST(row_number() OVER (PARTITION BY field ORDER BY prio, pos) - 1 AS INTEGER) AS local_id,
    CAST(row_number() OVER (ORDER BY f, prio, pos) - 1 AS INTEGER) AS global_id FROM toks)"""


def vocabulary(t):
    genes = t.part.select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"), F.col("p_partkey").alias("pos"))
    return so.build_vocabulary(genes, 10)


@query("set_vocab_build", f"WITH {VOCAB} SELECT * FROM vocab")
def _(t):
    return vocabulary(t)


@query("set_vocab_subset", f"""WITH {VOCAB}, k AS (SELECT * FROM vocab WHERE field <> 'genes' OR token LIKE '[%' OR token IN (SELECT 'g' || p_partkey FROM part WHERE p_size < 20))
  SELECT field, token, CAST(row_number() OVER (PARTITION BY field ORDER BY global_id) - 1 AS INTEGER) AS local_id,
    CAST(row_number() OVER (ORDER BY global_id) - 1 AS INTEGER) AS global_id FROM k""")
def _(t):
    listed = t.part.where("p_size < 20").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"))
    return so.subset_vocabulary(vocabulary(t), listed)


@query("set_overlap_counts", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'),
  b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), u AS (SELECT k FROM a UNION SELECT k FROM b)
  SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM u) AS n_union,
  (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS n_both, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS a_only,
  (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS b_only""")
def _(t):
    return so.overlap_counts(t.lineitem.where("l_returnflag = 'A'"), t.lineitem.where("l_returnflag = 'R'"), "l_partkey")


@query("set_membership_patterns", """WITH s AS (SELECT DISTINCT l_partkey, l_returnflag || l_linestatus AS source FROM lineitem),
  p AS (SELECT l_partkey, string_agg(source, '&' ORDER BY source) AS pattern FROM s GROUP BY 1)
  SELECT pattern, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    sources = t.lineitem.select("l_returnflag", "l_linestatus").distinct().collect()
    parts = {a + b: t.lineitem.where((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b)) for a, b in sorted(map(tuple, sources))}
    return so.membership_patterns(parts, "l_partkey", 3)


@query("set_prefix_counts", """SELECT substr(c_name, 1, 16) AS prefix, count(*) AS n FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def _(t):
    fin = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    named = fin.join(t.customer, "c_custkey").select("c_name")
    return so.prefix_counts(t.customer, named, "c_name", 16)


@query("set_case_duplicates", """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || p_size AS n FROM part)
  SELECT * FROM p WHERE upper(n) IN (SELECT upper(n) FROM p GROUP BY 1 HAVING count(*) > 1)""")
def _(t):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return so.case_duplicates(t.part.select("p_partkey", F.concat(name, F.col("p_size").cast("string")).alias("n")), "n")


@query("set_common_seq_removal", """SELECT text AS seq, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(DISTINCT lang) = 1""")
def _(t):
    rows = t.documents.select("doc_id", F.col("text").alias("seq"), "lang")
    return so.remove_common_sequences(rows, "seq", "lang", "doc_id").select("seq", "doc_id")


@query("set_dedup_interval", """SELECT user_id AS chrom, CAST(floor(value) AS BIGINT) AS start, CAST(floor(value) AS BIGINT) + 5 AS "end",
  min(event_id) AS event_id, arg_min(event_type, event_id) AS kind FROM events GROUP BY 1, 2""")
def _(t):
    lo = F.floor("value")
    rows = t.events.select(F.col("user_id").alias("chrom"), lo.alias("start"), (lo + 5).alias("end"), "event_id", F.col("event_type").alias("kind"))
    return so.dedup_first(rows, ["chrom", "start", "end"], "event_id")


@query("set_with_controls", views("pexpr", "pobs") + """SELECT cell_id, gene, value, CASE WHEN batch = 'P' AND perturbation <> 'Control' THEN perturbation ELSE 'non-targeting' END AS perturbation
  FROM pexpr JOIN pobs USING (cell_id) WHERE (batch = 'P' AND perturbation <> 'Control') OR perturbation = 'Control'""")
def _(t):
    cells = t.pobs.where("batch = 'P' and perturbation <> 'Control'")
    pred = t.pexpr.join(cells.select("cell_id"), "cell_id", "left_semi")
    rows, obs = so.add_controls(pred, cells, t.pexpr, t.pobs)
    return rows.join(obs, "cell_id")


@query("set_eval_subset", views("pobs") + """SELECT cell_id, CASE WHEN perturbation = 'Control' THEN 'non-targeting' ELSE perturbation END AS perturbation
  FROM pobs WHERE perturbation = 'Control' OR batch = 'P'""")
def _(t):
    b = F.when(F.col("batch") == "P", "test").otherwise("train")
    return so.eval_subset(t.pobs.withColumn("split", b)).select("cell_id", "perturbation")


@query("set_attr_join", """SELECT 'S' || l_suppkey AS gene, 'b' || l_partkey % 50 AS sample_id, round(arg_min(l_discount, (l_orderkey, l_linenumber, l_partkey)) - 0.05, 6) AS score
  FROM lineitem GROUP BY 1, 2""")
def _(t):
    rows = t.lineitem.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("gene"),
        F.concat(F.lit("b"), (F.col("l_partkey") % 50).cast("string")).alias("sample_id"),
        F.round(F.col("l_discount") - 0.05, 6).alias("score"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"))
    return so.join_attributions(rows, "o")

"""Queries for per-sample transforms."""

from pyspark.sql import functions as F

from tallgene.functions.rand import hash_int_sql as hi
from tallgene.functions.rand import hash_uniform_sql as hu
from tallgene.operators import samples as sm
from tallgene.operators import stats as st
from tallgene.operators.filters import dense_rows, dense_samples
from tallgene.plans.bind import views
from tallgene.plans.registry import query, rounded

E = views("expr")


def smp(t):
    return sm.build_samples(t.expr)


def rows(s, *keep):
    return sm.item_rows(s, *keep)


def numbered(src: str, order: str, cols: str = "cell_id, gene, value") -> str:
    return f"SELECT {cols}, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY {order}) - 1 AS INTEGER) AS pos FROM {src}"


@query("arr_build", E + numbered("expr", "gene"))
def _(t):
    return rows(smp(t))


@query("arr_shuffle", E + numbered("expr", hi(0, "cell_id", "gene") + ", gene"))
def _(t):
    return rows(sm.shuffle(smp(t)))


@query("arr_truncate", E + f"SELECT * FROM ({numbered('expr', 'gene')}) WHERE pos < 3")
def _(t):
    return rows(sm.truncate(smp(t), 3))


@query("arr_remap", E + "SELECT cell_id, 'x' || gene AS gene, value, pos FROM (" + numbered("expr", "gene") + ")")
def _(t):
    m = t.var.select("gene", F.concat(F.lit("x"), "gene").alias("new_gene"))
    return rows(sm.remap(smp(t), m))


@query("arr_limit_tokens", views("expr", "var") + numbered("(SELECT * FROM expr WHERE gene IN (SELECT gene FROM var WHERE size < 25))", "gene"))
def _(t):
    return rows(sm.limit_tokens(smp(t), t.var.where("size < 25")))


@query("arr_dropout", E + numbered(f"(SELECT * FROM expr WHERE {hu(0, 'cell_id', 'gene')} >= 0.3)", "gene"))
def _(t):
    return rows(sm.dropout(smp(t), 0.3))


@query("arr_dropout_chunk", E + f""", r AS ({numbered('expr', 'gene')}), n AS (SELECT cell_id, count(*) AS n, least(count(*) - 1, 5) - 1 + 1 AS room FROM r GROUP BY 1),
  s AS (SELECT cell_id, room, 1 + floor({hu(0, 'cell_id')} * (room - 2 + 1)) AS s FROM n),
  k AS (SELECT r.* FROM r JOIN s USING (cell_id) WHERE room < 2 OR pos < s OR pos >= s + 2) {numbered('k', 'gene')}""")
def _(t):
    return rows(sm.dropout_chunk(smp(t), 2, first=1, last=5))


@query("arr_dropout_selective", views("expr", "var") + f""", w AS (SELECT cell_id, gene, value, size / avg(size) OVER (PARTITION BY cell_id) AS w FROM expr JOIN var USING (gene)),
  k AS (SELECT cell_id, gene, value FROM w WHERE {hu(0, 'cell_id', 'gene')} > 0.3 * w / (1 + 0.3 * (w - 1))) {numbered('k', 'gene')}""")
def _(t):
    return rows(sm.dropout_selective(smp(t), t.var.select("gene", F.col("size").alias("weight")), 0.3))


@query("arr_uce", views("expr", "var") + f""", g AS (SELECT cell_id, gene, value, 'c' || (gene_pos % 5) AS chromosome, gene_pos AS start,
    coalesce(sum(ln(1 + value)) OVER (PARTITION BY cell_id ORDER BY gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
    sum(ln(1 + value)) OVER (PARTITION BY cell_id ORDER BY gene) AS hi, sum(ln(1 + value)) OVER (PARTITION BY cell_id) AS total
    FROM expr JOIN var USING (gene) WHERE kind <> 'PROMO'),
  d AS (SELECT cell_id, draw, {hu(0, 'cell_id', 'draw')} AS u FROM (SELECT DISTINCT cell_id FROM g), (SELECT unnest(range(1, 5)) AS draw)),
  x AS (SELECT g.cell_id, CAST(draw AS INTEGER) AS draw, gene, value, chromosome, start FROM d JOIN g ON g.cell_id = d.cell_id AND u * total >= lo AND u * total < hi)
  SELECT cell_id, draw, gene, value, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY {hi('0c', 'chromosome', 'cell_id')}, chromosome, start, gene, draw) - 1 AS INTEGER) AS pos FROM x""")
def _(t):
    loc = t.var.where("kind <> 'PROMO'").select("gene", F.concat(F.lit("c"), (F.col("gene_pos") % 5).cast("string")).alias("chromosome"), F.col("gene_pos").alias("start"))
    return sm.expression_repeats(t.expr, loc, 4).select("cell_id", "draw", "gene", "value", "pos")


RDA = f""", tot AS (SELECT cell_id, sum(value) AS raw FROM expr GROUP BY 1),
  gb AS (SELECT cell_id, raw, raw >= 120 AND {hu('0g', 'cell_id')} < 0.5 AS g, list_sort([{hu('0b0', 'cell_id')}, {hu('0b1', 'cell_id')}, {hu('0b2', 'cell_id')}])[2] AS b FROM tot),
  bp AS (SELECT cell_id, gene, value, k, least(b, 1 - b) AS q, b, {hu(0, 'cell_id', 'gene')} AS u FROM expr JOIN gb USING (cell_id), unnest(range(0, CAST(value AS BIGINT) + 1)) x(k) WHERE g),
  bc AS (SELECT *, sum(exp(lgamma(value + 1) - lgamma(k + 1) - lgamma(value - k + 1) + k * ln(q) + (value - k) * ln(1 - q))) OVER (PARTITION BY cell_id, gene ORDER BY k) AS cdf FROM bp),
  bd AS (SELECT cell_id, gene, least(any_value(value), count(*) FILTER (cdf <= CASE WHEN b <= 0.5 THEN u ELSE 1 - u END)) AS x, any_value(b) AS b FROM bc GROUP BY 1, 2),
  th AS (SELECT cell_id, gene, value, CASE WHEN NOT g THEN value WHEN gb.b <= 0.5 THEN x ELSE value - x END AS inp, raw
    FROM expr JOIN gb USING (cell_id) LEFT JOIN bd USING (cell_id, gene)),
  si AS (SELECT cell_id, sum(inp) AS si FROM th GROUP BY 1),
  body AS (SELECT cell_id, gene, ln(1 + CASE WHEN si = 0 THEN value ELSE inp END / CASE WHEN si = 0 THEN raw ELSE si END * 10000) AS value, ln(1 + value / raw * 10000) AS label,
    row_number() OVER (PARTITION BY cell_id ORDER BY gene) + 1 AS pos, raw, CASE WHEN si = 0 THEN raw ELSE si END AS used FROM th JOIN si USING (cell_id)),
  heads AS (SELECT DISTINCT cell_id, raw, used FROM body),
  allr AS (SELECT cell_id, pos, gene, value, label FROM body UNION ALL SELECT cell_id, 0, '[S]', ln(1 + used), ln(1 + used) FROM heads
    UNION ALL SELECT cell_id, 1, '[T]', ln(1 + raw), ln(1 + raw) FROM heads)
  SELECT cell_id, CAST(pos AS INTEGER) AS pos, gene, round(value, 6) AS value, round(label, 6) AS label FROM allr"""


@query("arr_rda_downsample", E + RDA)
def _(t):
    return rounded(rows(sm.rda_downsample(smp(t), 120.0)), "value", "label")


@query("arr_rda_equal", E + f""", r AS ({numbered('expr', 'gene')}), k AS (SELECT *, sum(value) OVER (PARTITION BY cell_id) AS s FROM r WHERE pos < 8)
  SELECT cell_id, pos + 2 AS pos, gene, round(ln(1 + value / s * 10000), 6) AS value, round(ln(1 + value / s * 10000), 6) AS label FROM k
  UNION ALL SELECT cell_id, p, g, round(ln(1 + s), 6), round(ln(1 + s), 6) FROM (SELECT DISTINCT cell_id, s FROM k), (VALUES (0, '[S]'), (1, '[T]')) v(p, g)""")
def _(t):
    return rounded(rows(sm.rda_equal(smp(t), max_length=10)), "value", "label")


@query("arr_rda_align", E + f""", k AS ({numbered('expr', 'gene', 'cell_id, gene, value, sum(value) OVER (PARTITION BY cell_id) AS s')})
  SELECT cell_id, pos + 2 AS pos, gene, round(ln(1 + value / s * 10000), 6) AS value FROM k
  UNION ALL SELECT cell_id, 0, '[S]', round(ln(1 + s), 6) FROM (SELECT DISTINCT cell_id, s FROM k) UNION ALL SELECT DISTINCT cell_id, 1, '[T]', round(ln(1 + 5000.0), 6) FROM k""")
def _(t):
    return rounded(rows(sm.rda_align(smp(t), 5000)), "value")


RR = 0.6 * 0.55


@query("arr_poisson_downsample", E + f""", p AS (SELECT cell_id, gene, value, k, value * {RR!r}::DOUBLE AS lam FROM expr, (SELECT unnest(range(0, 75)) AS k)),
  c AS (SELECT cell_id, gene, any_value(value) AS value, k, sum(exp(k * ln(lam) - lam - lgamma(k + 1))) AS pm FROM p GROUP BY cell_id, gene, k),
  d AS (SELECT cell_id, gene, value, sum(pm) OVER (PARTITION BY cell_id, gene ORDER BY k) AS cdf FROM c),
  n AS (SELECT cell_id, gene, any_value(value) AS value, count(*) FILTER (cdf <= {hu('0p', 'cell_id', 'gene')}) AS noise FROM d GROUP BY 1, 2),
  x AS (SELECT cell_id, gene, value, greatest(0, CASE WHEN {hu('0m', 'cell_id', 'gene')} >= {RR!r} THEN value - noise ELSE 0 END) AS inp FROM n),
  y AS (SELECT *, sum(inp) OVER (PARTITION BY cell_id) AS s, sum(value) OVER (PARTITION BY cell_id) AS t, row_number() OVER (PARTITION BY cell_id ORDER BY gene) + 1 AS pos FROM x)
  SELECT cell_id, CAST(pos AS INTEGER) AS pos, gene, round(ln(1 + inp), 6) AS value, round(value, 6) AS label FROM y
  UNION ALL SELECT DISTINCT cell_id, 0, '[S]', round(ln(1 + s), 6), round(ln(1 + s), 6) FROM y UNION ALL SELECT DISTINCT cell_id, 1, '[T]', round(ln(1 + t), 6), round(ln(1 + t), 6) FROM y""")
def _(t):
    return rounded(rows(sm.poisson_downsample(smp(t))), "value", "label")


def dense(t, make=dense_rows):
    cells = t.lineitem.select(F.col("l_orderkey").cast("string").alias("cell_id")).distinct()
    return make(t.pexpr, cells, t.part.select(F.col("p_brand").alias("gene")))


DENSE = views("pexpr")[:-1] + """, dense AS (SELECT cell_id, gene, coalesce(value, 0) AS value FROM (SELECT DISTINCT cell_id FROM pexpr)
  CROSS JOIN (SELECT DISTINCT p_brand AS gene FROM part) LEFT JOIN pexpr USING (cell_id, gene)) """


@query("arr_pad_random", DENSE + f"SELECT * FROM ({numbered('dense', 'CASE WHEN value > 0 THEN 0 ELSE 1 END, CASE WHEN value > 0 THEN 0 ELSE ' + hi(0, 'cell_id', 'gene') + ' END, gene')}) WHERE pos < 12 OR value > 0")
def _(t):
    return rows(sm.pad_random(dense(t, dense_samples), 12))


BATCHED = DENSE + f""", b AS (SELECT cell_id, CAST(cell_id AS BIGINT) // 4 AS batch_id, gene, value, row_number() OVER (PARTITION BY cell_id ORDER BY gene) - 1 AS p FROM dense),
  sn AS (SELECT DISTINCT batch_id, gene FROM b WHERE value > 0),
  c AS (SELECT b.*, CASE WHEN value > 0 THEN 0 WHEN sn.gene IS NOT NULL THEN 1 ELSE 2 END AS cl FROM b LEFT JOIN sn USING (batch_id, gene)),
  k AS (SELECT *, CASE WHEN cl = 0 THEN p ELSE {hi(0, 'cell_id', 'gene')} END AS key FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY cell_id, cl ORDER BY key, gene) - 1 AS rk, count(*) FILTER (cl = 0) OVER (PARTITION BY cell_id) AS na,
    count(*) FILTER (cl = 1) OVER (PARTITION BY cell_id) AS nb FROM k)"""


def batched(t):
    return sm.item_rows(sm.build_samples(dense(t))).withColumn("batch_id", F.floor(F.col("cell_id").cast("bigint") / 4))


@query("arr_pad_batchwise", BATCHED + """SELECT * FROM (SELECT cell_id, batch_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY cl, rk) - 1 AS INTEGER) AS pos, gene, value FROM r) WHERE pos < 14""")
def _(t):
    return sm.pad_batchwise(batched(t), 14)


@query("arr_interleave", BATCHED + """, cy AS (SELECT *, least(na // 7, nb // 3) AS cyc FROM r),
  o AS (SELECT *, CASE cl WHEN 0 THEN CASE WHEN rk < cyc * 7 THEN (rk // 7) * 10 + rk % 7 ELSE 1000000 + rk END
    WHEN 1 THEN CASE WHEN rk < cyc * 3 THEN (rk // 3) * 10 + 7 + rk % 3 ELSE 2000000 + rk END ELSE 3000000 + rk END AS ok FROM cy)
  SELECT * FROM (SELECT cell_id, batch_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY ok) - 1 AS INTEGER) AS pos, gene, value FROM o) WHERE pos < 20""")
def _(t):
    return sm.pad_batchwise(batched(t), 20, interleave=0.7)


@query("arr_pad_batchwise_expressed", BATCHED + f"""SELECT * FROM (SELECT cell_id, batch_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY cl, rk) - 1 AS INTEGER) AS pos, gene, value, cl FROM r)
  WHERE pos < 14 AND ({hu('0e', 'cell_id')} >= 0.5 OR cl = 0)""".replace("SELECT * FROM (", "SELECT cell_id, batch_id, pos, gene, value FROM ("))
def _(t):
    return sm.pad_batchwise(batched(t), 14, expressed_only=0.5)


@query("arr_datastore_field", views("expr", "obs") + """SELECT cell_id, gene, value, round(ln(1 + CASE WHEN gene_pos % 3 <> ascii(batch) % 3 THEN price ELSE 0 END), 6) AS feature
  FROM expr JOIN obs USING (cell_id) JOIN (SELECT CAST(p_partkey AS VARCHAR) AS gene, p_partkey AS gene_pos, p_retailprice AS price FROM part) USING (gene)""")
def _(t):
    names = t.orders.select(F.col("o_orderstatus").alias("biosample_name")).distinct()
    listed = names.select(F.collect_list("biosample_name")).scalar()
    store = t.part.select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("gene_symbol"), "p_retailprice", F.explode(listed).alias("biosample_name"))
    store = store.where((F.col("k") % 3) != (F.ascii("biosample_name") % 3))
    cells = t.expr.join(t.obs.select("cell_id", F.col("batch").alias("biosample_name")), "cell_id")
    return rounded(sm.add_datastore_field(cells, store, "p_retailprice", "feature", log=True).select("cell_id", "gene", "value", "feature"), "feature")


@query("arr_compose", views("expr", "var") + f""", m AS (SELECT gene, median(value) AS m FROM expr GROUP BY 1),
  a AS (SELECT cell_id, gene, value / m AS value FROM expr JOIN m USING (gene) JOIN var USING (gene) WHERE size < 40),
  b AS ({numbered('a', 'value DESC, gene')}), c AS (SELECT cell_id, gene, value, pos FROM b WHERE pos < 6),
  d AS (SELECT * FROM c WHERE {hu(0, 'cell_id', 'gene')} >= 0.2),
  e AS (SELECT cell_id, gene, ln(1 + value / (sum(value) OVER (PARTITION BY cell_id) + 1) * 10000) AS value, pos FROM d)
  SELECT cell_id, 'h' || gene AS gene, CAST(round_even(value, 0) AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY pos) - 1 AS INTEGER) AS pos FROM e""")
def _(t):
    orth = t.var.select("gene", F.concat(F.lit("h"), "gene").alias("new_gene"))
    out = sm.compose(smp(t), medians=st.gene_median(t.expr), tokens=t.var.where("size < 40"), drop_fraction=0.2, sequence_order="sorted",
                     max_length=6, normalize=True, round_values=True, orthologs=orth)
    return rows(out)


@query("arr_compose_depth", E + f""", r AS ({numbered('expr', hi(0, 'cell_id', 'gene') + ', gene')}), k AS (SELECT *, sum(value) OVER (PARTITION BY cell_id) AS s FROM r WHERE pos < 4)
  SELECT cell_id, pos + 2 AS pos, gene, round(ln(1 + value / s * 10000), 6) AS value, round(ln(1 + value / s * 10000), 6) AS label FROM k
  UNION ALL SELECT cell_id, p, g, round(ln(1 + s), 6), round(ln(1 + s), 6) FROM (SELECT DISTINCT cell_id, s FROM k), (VALUES (0, '[S]'), (1, '[T]')) v(p, g)""")
def _(t):
    return rounded(rows(sm.compose(smp(t), sequence_order="random", max_length=6, normalize=True, depth="equal")), "value", "label")

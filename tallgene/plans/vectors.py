"""Queries for embedding evaluation and label ontologies."""

from pyspark.sql import functions as F

from tallgene.functions.lineage import dealt
from tallgene.functions.rand import hash_int_sql
from tallgene.operators import embed as em
from tallgene.operators import examples as ex
from tallgene.operators import harmonise as hz
from tallgene.operators import ontology as on
from tallgene.plans.bind import views
from tallgene.plans.registry import query, rounded

M = views("embl") + ", m AS (SELECT label, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM embl GROUP BY 1, 2)"


@query("emb_cohesion", M + """, p AS (SELECT label, sum(ss - s * s / n) AS c FROM m GROUP BY 1) SELECT label, round(c, 2) AS cohesion FROM p UNION ALL SELECT NULL, round(avg(c), 2) FROM p""")
def _(t):
    return rounded(em.cohesion(t.emb), "cohesion", digits=2)


BW = """, tt AS (SELECT dim, sum(s) AS sa, sum(n) AS na FROM m GROUP BY 1),
  bw AS (SELECT sum(n * (s / n - sa / na) * (s / n - sa / na)) AS b, sum(ss - s * s / n) AS w, max(na) AS n, count(DISTINCT label) AS k FROM m JOIN tt USING (dim))"""


@query("emb_separation", M + BW + " SELECT round(b, 2) AS separation FROM bw")
def _(t):
    return rounded(em.separation(t.emb), "separation", digits=2)


@query("emb_ch_db", M + BW + """, c AS (SELECT label, dim, s / n AS c FROM m), d AS (SELECT vec_id, label, sqrt(sum((x - c) * (x - c))) AS d FROM embl JOIN c USING (label, dim) GROUP BY 1, 2),
  sp AS (SELECT label, avg(d) AS s FROM d GROUP BY 1), cd AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY 1, 2),
  r AS (SELECT i, max((x.s + y.s) / d) AS r FROM cd JOIN sp x ON x.label = i JOIN sp y ON y.label = j GROUP BY 1)
  SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz, round((SELECT avg(r) FROM r), 6) AS davies_bouldin FROM bw""")
def _(t):
    out = em.ch_db(t.emb)
    return rounded(rounded(out, "calinski_harabasz", digits=4), "davies_bouldin")


SIL = views("emb") + """, p AS (SELECT a.vec_id, a.{0} AS own, b.{0} AS oth, sum(list_distance(a.vec, b.vec)) AS s, count(*) AS n FROM emb a JOIN emb b ON {1} GROUP BY 1, 2, 3),
  ab AS (SELECT vec_id, own, max(n) FILTER (own = oth) AS n, max(s / (n - 1)) FILTER (own = oth AND n > 1) AS a, min(s / n) FILTER (own <> oth) AS b FROM p GROUP BY 1, 2),
  sl AS (SELECT vec_id, CASE WHEN b IS NULL THEN NULL WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS v FROM ab)"""


@query("emb_silhouette", SIL.format("label", "TRUE") + " SELECT round(avg(v), 6) AS silhouette FROM sl")
def _(t):
    return rounded(em.silhouette(t.emb, block=256), "silhouette")


@query("emb_batch_asw", SIL.format("batch", "a.label = b.label") + """, q AS (SELECT label, avg(1 - abs(v)) AS v FROM sl JOIN emb USING (vec_id) WHERE v IS NOT NULL GROUP BY 1) SELECT round(avg(v), 6) AS asw_batch FROM q""")
def _(t):
    return rounded(em.batch_asw(t.emb), "asw_batch")


@query("emb_knn_graph", views("emb") + """SELECT * FROM (SELECT a.vec_id, b.vec_id AS neighbor, round(list_distance(a.vec, b.vec), 5) AS distance,
  CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.vec, b.vec), 9), b.vec_id) AS INTEGER) AS rank FROM emb a JOIN emb b ON a.vec_id <> b.vec_id) WHERE rank <= 10""")
def _(t):
    return rounded(em.knn(t.emb, 10, block=256), "distance", digits=5).select("vec_id", "neighbor", "distance", "rank")


def _top_axis(name: str, of: str, squarings: int = 24) -> str:
    """SQL: unit vector ``name``.v of largest variance and its variance ``name``.l, by squaring a symmetric matrix (rows m of ``of``) again and again."""
    return f"""{name}_p(i, m) AS (SELECT 0, m FROM {of} UNION ALL
    SELECT i + 1, [[x / t FOR x IN r] FOR r IN m2] FROM (
    SELECT i, [[list_dot_product(r, c) FOR c IN m] FOR r IN m] AS m2, pow(list_sum([q[j] FOR q, j IN m]), 2) AS t FROM {name}_p WHERE i < {squarings})),
  {name}_c AS (SELECT unnest(m) AS r FROM {name}_p WHERE i = {squarings}),
  {name}_u AS (SELECT arg_max(r, list_dot_product(r, r)) AS r FROM {name}_c),
  {name} AS (SELECT [x / sqrt(list_dot_product(r, r)) FOR x IN r] AS v FROM {name}_u)"""


PCA_SQL = views("emb").replace("WITH ", "WITH RECURSIVE ", 1) + """, d AS (SELECT vec_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM emb),
  mu AS (SELECT i, avg(x) AS mu FROM d GROUP BY i), mul AS (SELECT list(mu ORDER BY i) AS mu FROM mu),
  ce AS (SELECT vec_id, [x - mu[j] FOR x, j IN vec] AS z FROM emb, mul),
  z AS (SELECT vec_id, unnest(z) AS z, generate_subscripts(z, 1) AS i FROM ce),
  cv AS (SELECT a.i, b.i AS j, sum(a.z * b.z) / ((SELECT count(*) FROM emb) - 1) AS c FROM z a JOIN z b USING (vec_id) GROUP BY 1, 2),
  cr AS (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY i), m1 AS (SELECT list(r ORDER BY i) AS m FROM cr),
  """ + _top_axis("a1", "m1") + """,
  l1 AS (SELECT v, m, list_dot_product(v, [list_dot_product(r, v) FOR r IN m]) AS l FROM a1, m1),
  m2 AS (SELECT [[c - l * v[i] * v[j] FOR c, j IN r] FOR r, i IN m] AS m FROM l1),
  """ + _top_axis("a2", "m2") + """
  SELECT vec_id, round(abs(list_dot_product(z, a1.v)), 4) AS pc1, round(abs(list_dot_product(z, a2.v)), 4) AS pc2 FROM ce, a1, a2"""


@query("emb_pca", PCA_SQL)
def _(t):
    out = em.pca(t.emb, 2)
    return out.select("vec_id", F.round(F.abs(F.col("pca")[0]), 4).alias("pc1"), F.round(F.abs(F.col("pca")[1]), 4).alias("pc2"))


def kmeans_sql(rounds: int = 20, k: int = 10) -> str:
    """Common table expressions of Lloyd's rounds: ``k`` holds each vector's cluster."""
    out = f""", c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY {hash_int_sql(0, 'vec_id')}, vec_id) - 1 AS INTEGER) AS cluster, vec AS c FROM emb QUALIFY cluster < {k})"""
    near = "SELECT vec_id, any_value(vec) AS vec, arg_min(cluster, (list_dot_product(c, c) - 2 * list_dot_product(vec, c), cluster)) AS cluster FROM emb, {0} GROUP BY vec_id"
    for i in range(rounds):
        out += f""", k{i} AS MATERIALIZED ({near.format(f"c{i}")}), s{i} AS (SELECT cluster, d, avg(x) AS x FROM (SELECT cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM k{i}) GROUP BY ALL),
  c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(l, c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(x ORDER BY d) AS l FROM s{i} GROUP BY cluster) USING (cluster))"""
    return out + f", k AS ({near.format(f'c{rounds}')})"


@query("emb_kmeans", views("emb") + kmeans_sql() + " SELECT vec_id, label, k.cluster FROM emb JOIN k USING (vec_id)")
def _(t):
    return em.kmeans(t.emb, 10).select("vec_id", "label", "cluster")


@query("emb_contingency", """WITH c AS (SELECT l_returnflag AS l, l_linestatus || l_linenumber % 3 AS c, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
  m AS (SELECT *, sum(n) OVER (PARTITION BY l) AS a, sum(n) OVER (PARTITION BY c) AS b, sum(n) OVER () AS t FROM c),
  s AS (SELECT sum(n * (n - 1) / 2) AS ij, max(t * (t - 1) / 2) AS al, sum(n / t * ln(n * t / (a * b))) AS mi, sum(-n / t * ln(a / t)) AS hl, sum(-n / t * ln(b / t)) AS hc,
    (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM c GROUP BY l)) AS i, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM c GROUP BY c)) AS j FROM m)
  SELECT round((ij - i * j / al) / ((i + j) / 2 - i * j / al), 6) AS ari, round(mi / ((hl + hc) / 2), 6) AS nmi FROM s""")
def _(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("label"), F.concat("l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("cluster"))
    return rounded(em.contingency_scores(rows), "ari", "nmi")


@query("emb_adjusted_mutual_info", """WITH c AS (SELECT l_returnflag AS l, l_linestatus AS c, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
  a AS (SELECT l, sum(n) AS a FROM c GROUP BY 1), b AS (SELECT c, sum(n) AS b FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
  mi AS (SELECT sum(n / t * ln(n * t / a / b)) AS mi FROM c JOIN a USING (l) JOIN b USING (c), t),
  k AS (SELECT a, b, t, unnest(range(CAST(greatest(1, a + b - t) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1))::DOUBLE AS k FROM a, b, t),
  e AS (SELECT sum(k / t * (ln(k / a) + ln(t / b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1)
    - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS emi FROM k),
  h AS (SELECT ((SELECT sum(-a / t * ln(a / t)) FROM a, t) + (SELECT sum(-b / t * ln(b / t)) FROM b, t)) / 2 AS h)
  SELECT round((mi - emi) / (h - emi), 6) AS ami FROM mi, e, h""")
def _(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("cluster"))
    return rounded(em.adjusted_mutual_info(rows), "ami")


def sil_sql(column: str, within: str, name: str) -> str:
    """Common table expressions of the silhouette by ``column``: ``name``(vec_id, own, v)."""
    made = SIL.format(column, within).removeprefix(views("emb"))
    for old in ("p", "ab", "sl"):
        made = made.replace(f" {old} AS (", f" {name if old == 'sl' else name + old} AS (").replace(f"FROM {old} ", f"FROM {name + old} ").replace(f"FROM {old})", f"FROM {name + old})")
    return made


BATCH_SQL = views("emb").replace("WITH ", "WITH RECURSIVE ", 1) + kmeans_sql() + """, ct AS (SELECT label AS l, k.cluster AS c, count(*)::DOUBLE AS n FROM emb JOIN k USING (vec_id) GROUP BY 1, 2),
  mt AS (SELECT *, sum(n) OVER (PARTITION BY l) AS a, sum(n) OVER (PARTITION BY c) AS b, sum(n) OVER () AS t FROM ct),
  sc AS (SELECT sum(n * (n - 1) / 2) AS ij, max(t * (t - 1) / 2) AS al, sum(n / t * ln(n * t / (a * b))) AS mi, sum(-n / t * ln(a / t)) AS hl, sum(-n / t * ln(b / t)) AS hc,
    (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM ct GROUP BY l)) AS i, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM ct GROUP BY c)) AS j FROM mt)""" + (
    sil_sql("label", "TRUE", "ls") + sil_sql("batch", "a.label = b.label", "bs")) + """,
  bb AS (SELECT avg(v) AS asw_batch FROM (SELECT label, avg(1 - abs(v)) AS v FROM bs JOIN emb USING (vec_id) WHERE v IS NOT NULL GROUP BY 1)),
  nn AS (SELECT vec_id, neighbor FROM (SELECT a.vec_id, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.vec, b.vec), 9), b.vec_id) AS rank
    FROM emb a JOIN emb b ON a.vec_id <> b.vec_id) WHERE rank <= 15),
  ed AS (SELECT vec_id AS x, neighbor AS y FROM nn JOIN emb a USING (vec_id) JOIN emb b ON b.vec_id = neighbor WHERE a.label = b.label),
  bo AS (SELECT x, y FROM ed UNION SELECT y, x FROM ed),
  re AS (SELECT vec_id AS x, vec_id AS y FROM emb UNION SELECT re.x, bo.y FROM re JOIN bo ON bo.x = re.y),
  co AS (SELECT x AS vec_id, min(y) AS comp FROM re GROUP BY 1),
  gc AS (SELECT avg(share) AS graph_conn FROM (SELECT label, max(n) / sum(n) AS share FROM (SELECT label, comp, count(*) AS n FROM co JOIN emb USING (vec_id) GROUP BY 1, 2) GROUP BY 1)),
  al AS (SELECT mi / ((hl + hc) / 2) AS nmi, (ij - i * j / al) / ((i + j) / 2 - i * j / al) AS ari, (SELECT (avg(v) + 1) / 2 FROM ls) AS asw_label, graph_conn, asw_batch FROM sc, gc, bb)
  SELECT round(nmi, 3) AS nmi, round(ari, 3) AS ari, round(asw_label, 3) AS asw_label, round((nmi + ari + asw_label) / 3, 3) AS avg_bio, round(graph_conn, 3) AS graph_conn,
    round(asw_batch, 3) AS asw_batch, round((graph_conn + asw_batch) / 2, 3) AS avg_batch FROM al"""


@query("emb_batch_metrics", BATCH_SQL)
def _(t):
    return em.batch_metrics(t.emb)


@query("emb_linear_probe")
def _(t):
    split = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "dev").otherwise("train")
    return em.linear_probe(t.emb.withColumn("split", split))


# ontology: root -> part type -> brand -> part, with shared children ------------------------------------

NODES = """tm AS (SELECT 'root' AS id, 'all' AS name, FALSE AS obsolete UNION ALL SELECT DISTINCT p_type, p_type, p_type = 'LARGE' FROM part UNION ALL SELECT DISTINCT p_brand, p_brand, FALSE FROM part
    UNION ALL SELECT 'P' || p_partkey, p_name, FALSE FROM part),
  sup AS (SELECT DISTINCT 'root' AS parent, p_type AS child FROM part UNION ALL SELECT DISTINCT p_type, p_brand FROM part WHERE p_size <= 20 UNION ALL SELECT p_brand, 'P' || p_partkey FROM part
    UNION ALL SELECT DISTINCT p_brand, p_brand FROM part),
  nd AS (SELECT id, name FROM tm WHERE NOT obsolete), ed AS (SELECT DISTINCT parent, child FROM sup WHERE parent <> child AND parent IN (SELECT id FROM nd) AND child IN (SELECT id FROM nd))"""
CLOSE = "WITH RECURSIVE " + NODES + """, cl AS (SELECT id AS ancestor, id AS node, 0 AS dist FROM nd UNION SELECT cl.ancestor, ed.child, dist + 1 FROM cl JOIN ed ON cl.node = ed.parent),
  cm AS (SELECT ancestor, node, min(dist) AS dist FROM cl GROUP BY 1, 2), lf AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS label_id FROM nd WHERE id NOT IN (SELECT parent FROM ed))"""


def terms(t):
    p = dealt(t.part.select("p_partkey", "p_name", "p_type", "p_brand", "p_size"), "p_partkey")
    key = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    root = F.concat(F.lit("root"), F.substring("p_type", 1, 0))  # not a constant, so joins on it stay equi joins

    def row(i, n, o=None):
        return p.select(i.alias("id"), n.alias("name"), (F.lit(False) if o is None else o).alias("obsolete")).distinct()

    nodes = row(root, F.lit("all")).unionByName(row(F.col("p_type"), F.col("p_type"), F.col("p_type") == "LARGE")).unionByName(
        row(F.col("p_brand"), F.col("p_brand"))).unionByName(row(key, F.col("p_name")))

    def edge(df, a, b):
        return df.select(a.alias("parent"), b.alias("child")).distinct()

    sup = edge(p, root, F.col("p_type")).unionByName(edge(p.where("p_size <= 20"), F.col("p_type"), F.col("p_brand"))).unionByName(
        edge(p, F.col("p_brand"), key)).unionByName(edge(p, F.col("p_brand"), F.col("p_brand")))
    return nodes, sup


def graph(t):
    return on.build(*terms(t))


@query("ont_build", "WITH " + NODES + " SELECT parent, child FROM ed UNION ALL SELECT id, NULL FROM nd")
def _(t):
    nodes, edges = graph(t)
    return edges.unionByName(nodes.select(F.col("id").alias("parent"), F.lit(None).cast("string").alias("child")))


@query("ont_leaves", CLOSE + " SELECT id, label_id FROM lf")
def _(t):
    return on.leaves(*graph(t))


@query("ont_closure", CLOSE + " SELECT ancestor, node, dist FROM cm")
def _(t):
    return on.closure(*graph(t))


@query("ont_find_leaves", CLOSE + " SELECT ancestor, node AS leaf FROM cm WHERE node IN (SELECT id FROM lf) AND (ancestor IN (SELECT p_brand FROM part WHERE p_brand < 'Brand#15') OR ancestor IN ('SMALL', 'P17'))")
def _(t):
    nodes, edges = graph(t)
    asked = t.part.where("p_brand < 'Brand#15'").select(F.col("p_brand").alias("id")).unionByName(
        t.part.select(F.explode(F.array(F.lit("SMALL"), F.lit("P17"), F.lit("not there"))).alias("id"))).distinct()
    return on.find_leaves(on.closure(nodes, edges), on.leaves(nodes, edges), asked)


@query("ont_prune_dead_leaves", CLOSE + """, ob AS (SELECT 'P' || p_partkey AS id FROM part WHERE p_size > 45 AND p_type = 'PROMO'), al AS (SELECT DISTINCT ancestor FROM cm WHERE node IN (SELECT id FROM ob))
  SELECT parent, child FROM ed WHERE parent IN (SELECT ancestor FROM al) AND child IN (SELECT ancestor FROM al) UNION ALL SELECT id, NULL FROM nd WHERE id IN (SELECT ancestor FROM al)""")
def _(t):
    nodes, edges = graph(t)
    seen = t.part.where("p_size > 45 and p_type = 'PROMO'").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    n, e = on.prune_dead_leaves(nodes, edges, on.closure(nodes, edges), seen)
    return e.select("parent", "child").unionByName(n.select(F.col("id").alias("parent"), F.lit(None).cast("string").alias("child")))


@query("ont_coverage", "WITH " + NODES + " SELECT DISTINCT p_type AS id FROM part WHERE p_type NOT IN (SELECT id FROM nd)")
def _(t):
    return on.missing_ids(t.part.select(F.col("p_type").alias("id")), graph(t)[0])


@query("jn_general_cell_type", CLOSE + """, up AS (SELECT node, arg_min(ancestor, dist * 1000 + list_position(['ECONOMY', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], ancestor)) AS top FROM cm WHERE ancestor IN ('ECONOMY', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD') GROUP BY 1)
  SELECT l_orderkey, l_linenumber, l_partkey, cell_type, CASE WHEN cell_type LIKE 'x%' THEN cell_type ELSE coalesce(top, nd.name) END AS general
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'x' || l_partkey ELSE 'P' || l_partkey END AS cell_type FROM lineitem) LEFT JOIN up ON node = cell_type LEFT JOIN nd ON nd.id = cell_type""")
def _(t):
    nodes, edges = graph(t)
    pre = F.when(F.col("l_returnflag") == "R", "x").otherwise("P")
    obs = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(pre, F.col("l_partkey").cast("string")).alias("cell_type"))
    ids = nodes.select(F.col("id").alias("label"), "id")
    high = t.part.where("p_type <> 'LARGE'").select(F.col("p_type").alias("id")).distinct()
    return hz.general_cell_type(obs, ids, on.closure(nodes, edges), high, nodes).select("l_orderkey", "l_linenumber", "l_partkey", "cell_type", "general")


@query("mat_label_ontology", CLOSE + """, pl AS (SELECT ancestor, string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY label_id) AS leaf_ids FROM cm JOIN lf ON lf.id = node GROUP BY 1)
  SELECT l_orderkey, l_linenumber, l_partkey, coalesce(leaf_ids, '') AS leaf_ids, (leaf_ids IS NOT NULL)::INT AS has_leaves
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'none' WHEN l_orderkey <= 64 THEN 'Brand#' || (l_suppkey % 25 + 1) ELSE 'P' || l_partkey END AS lab FROM lineitem) LEFT JOIN pl ON ancestor = lab""")
def _(t):
    nodes, edges = graph(t)
    # lines of the first orders are labelled with a brand, an inner node, so that the paths below a label count and not only the label itself
    brand = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string"))
    lab = F.when(F.col("l_returnflag") == "R", "none").when(F.col("l_orderkey") <= 64, brand).otherwise(F.concat(F.lit("P"), F.col("l_partkey").cast("string")))
    obs = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", lab.alias("lab"))
    out = ex.label_ontology(obs, on.leaves(nodes, edges), on.closure(nodes, edges), "lab")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.col("leaf_ids").cast("array<string>"), ",").alias("leaf_ids"), "has_leaves")

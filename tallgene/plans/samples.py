"""Queries for splits and samples."""

from pyspark.sql import functions as F

from tallgene.functions.rand import hash_int_sql as hi
from tallgene.functions.rand import hash_uniform_sql as hu
from tallgene.operators import sampling as sp
from tallgene.plans.bind import views
from tallgene.plans.registry import query, rounded

W = {"train": 0.7, "dev": 0.1, "test": 0.2}


@query("spl_random", views("obs") + f"""SELECT cell_id, CASE WHEN {hu(42, 'cell_id')} < 0.7 THEN 'train' WHEN {hu(42, 'cell_id')} < 0.8 THEN 'dev' ELSE 'test' END AS split FROM obs""")
def _(t):
    w = {"train": 0.7, "dev": 0.1, "test": 0.2}
    return sp.random_split(t.obs.select("cell_id"), w, ["cell_id"])


@query("spl_stratified", views("obs") + f""", r AS (SELECT cell_id, label, row_number() OVER (PARTITION BY label ORDER BY {hi(42, 'cell_id')}, cell_id) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM obs), s AS (SELECT *, round(n * 0.2) AS nt FROM r)
  SELECT cell_id, label, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + round((n - nt) * (0.1::DOUBLE / (0.7::DOUBLE + 0.1::DOUBLE))) THEN 'dev' ELSE 'train' END AS split FROM s""")
def _(t):
    return sp.stratified_split(t.obs.select("cell_id", "label"), "label", W, ["cell_id"])


NAMES = """, nm AS (SELECT DISTINCT perturbation AS p, contains(perturbation, '_') AS combo FROM pobs WHERE perturbation <> 'Control')"""
SINGLES = NAMES + f""", st AS (SELECT p, row_number() OVER (ORDER BY {hi('42t', 'p')}, p) <= greatest(1, floor(count(*) OVER () * 0.2)) AS t FROM nm WHERE NOT combo),
  sd AS (SELECT p, row_number() OVER (ORDER BY {hi('42d', 'p')}, p) <= greatest(1, floor(count(*) OVER () * 0.1)) AS d FROM st WHERE NOT t),
  sing AS (SELECT p, 'test' AS split FROM st WHERE t UNION ALL SELECT p, CASE WHEN d THEN 'dev' ELSE 'train' END FROM sd)"""
ATTACH = """ SELECT cell_id, perturbation, CASE WHEN perturbation = 'Control' THEN 'train' ELSE split END AS split FROM pobs LEFT JOIN fin ON p = perturbation"""
W2 = {"train": 0.7, "dev": 0.1, "test": 0.2}
PO = ["cell_id", "perturbation", "split"]


@query("spl_pert_single_only", views("pobs") + SINGLES + ", fin AS (SELECT * FROM sing)" + ATTACH)
def _(t):
    return sp.split_single_only(t.pobs, W2).select(*PO)


@query("spl_pert_single", views("pobs") + NAMES + f""",
  st AS (SELECT p, row_number() OVER (ORDER BY {hi('42t', 'p')}, p) <= greatest(1, floor(count(*) OVER () * 0.2)) AS t FROM nm WHERE NOT combo),
  te AS (SELECT p FROM st WHERE t),
  parts AS (SELECT p, unnest(string_split(p, '_')) AS g FROM nm WHERE combo),
  tr AS (SELECT p, combo FROM nm WHERE p NOT IN (SELECT p FROM te) AND p NOT IN (SELECT p FROM parts WHERE g IN (SELECT p FROM te))),
  dv AS (SELECT p, row_number() OVER (ORDER BY {hi('42d', 'p')}, p) <= greatest(1, floor(count(*) OVER () * 0.1)) AS d FROM tr WHERE NOT combo),
  de AS (SELECT p FROM dv WHERE d),
  fin AS (SELECT p, 'test' AS split FROM te UNION ALL SELECT p, 'dev' FROM de UNION ALL SELECT p, 'train' FROM tr WHERE p NOT IN (SELECT p FROM de)
    AND p NOT IN (SELECT p FROM parts WHERE g IN (SELECT p FROM de)))""" + ATTACH)
def _(t):
    return sp.split_single_and_combos(t.pobs, W2).select(*PO)


SEEN = SINGLES + """, seen AS (SELECT p, count(*) FILTER (g IN (SELECT p FROM sing WHERE split = 'train')) AS seen
  FROM (SELECT p, unnest(string_split(p, '_')) AS g FROM nm WHERE combo) GROUP BY 1)"""


def _seen_sql(k: int) -> str:
    return views("pobs") + SEEN + f""", ct AS (SELECT p, row_number() OVER (ORDER BY {hi('42ct', 'p')}, p) <= greatest(1, floor(count(*) OVER () * 0.2)) AS t FROM seen WHERE seen = {k}),
  cd AS (SELECT p, row_number() OVER (ORDER BY {hi('42cd', 'p')}, p) <= greatest(1, floor(count(*) OVER () * 0.1)) AS d FROM ct WHERE NOT t),
  mv AS (SELECT p, 'test' AS split FROM ct WHERE t UNION ALL SELECT p, 'dev' FROM cd WHERE d),
  fin AS (SELECT * FROM sing UNION ALL SELECT * FROM mv UNION ALL SELECT p, 'train' FROM seen WHERE p NOT IN (SELECT p FROM mv))""" + ATTACH


for _k in (0, 1, 2):
    query("spl_pert_combo_seen" + ("" if _k == 1 else str(_k)), _seen_sql(_k))(lambda t, k=_k: sp.split_combo_seen(t.pobs, W2, k).select(*PO))


def _half(k: int, src: str) -> str:
    return f"""h{k} AS (SELECT p, CASE WHEN row_number() OVER (ORDER BY {hi(f'42h{k}', 'p')}, p) <= floor(count(*) OVER () * 0.5) THEN 'test' ELSE 'dev' END AS split FROM {src})"""


@query("spl_pert_simulation", views("pobs") + SEEN + f""", two AS (SELECT p, row_number() OVER (ORDER BY {hi('42s2', 'p')}, p) <= floor(count(*) OVER () * 0.85) AS t FROM seen WHERE seen = 2),
  z0 AS (SELECT p FROM seen WHERE seen = 0), z1 AS (SELECT p FROM seen WHERE seen = 1), z2 AS (SELECT p FROM two WHERE NOT t),
  {_half(0, 'z0')}, {_half(1, 'z1')}, {_half(2, 'z2')},
  fin AS (SELECT p, split, CASE WHEN split <> 'train' THEN 'unseen_single_' || split END AS "group" FROM sing UNION ALL SELECT p, 'train', NULL FROM two WHERE t
    UNION ALL SELECT p, split, 'combo_seen0_' || split FROM h0 UNION ALL SELECT p, split, 'combo_seen1_' || split FROM h1 UNION ALL SELECT p, split, 'combo_seen2_' || split FROM h2)
  SELECT cell_id, perturbation, CASE WHEN perturbation = 'Control' THEN 'train' ELSE split END AS split, "group" FROM pobs LEFT JOIN fin ON p = perturbation""")
def _(t):
    return sp.split_simulation(t.pobs, W2).select(*PO, "group")


@query("spl_by_dataset_coverage", """WITH RECURSIVE c AS (SELECT source AS dataset, concat_ws('/', lang, length(text) % 5) AS t, count(*) AS n FROM documents GROUP BY ALL),
  d AS (SELECT dataset, list(t) AS types, count(*) AS k, sum(n) AS n FROM c GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY k, n, dataset) AS i FROM d),
  f(i, dataset, split, train, dev) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[] UNION ALL
    SELECT i, dataset, CASE WHEN go THEN 'dev' ELSE 'train' END, CASE WHEN go THEN train ELSE list_concat(train, types) END, CASE WHEN go THEN list_concat(dev, types) ELSE dev END FROM (
      SELECT o.i, o.dataset, o.types, f.train, f.dev, list_has_all(f.train, o.types) AND NOT list_has_all(f.dev, o.types) AS go FROM f JOIN o ON o.i = f.i + 1))
  SELECT dataset, split FROM f WHERE i > 0""")
def _(t):
    rows = t.documents.select(F.col("source").alias("dataset"), F.concat_ws("/", "lang", F.length("text") % 5).alias("cell_type"))
    return sp.split_by_coverage(rows)


@query("spl_by_fold", """SELECT doc_id, CAST(n_chars % 12 AS BIGINT) AS fold, CASE WHEN n_chars % 12 <= 5 THEN 'train' WHEN n_chars % 12 <= 7 THEN 'dev' WHEN n_chars % 12 <= 9 THEN 'test' END AS split FROM documents""")
def _(t):
    return sp.split_by_fold(t.documents.select("doc_id", (F.col("n_chars") % 12).alias("fold")))


@query("spl_positional", """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'dev' END AS split FROM events""")
def _(t):
    return sp.split_positional(t.events.select("event_id"), "event_id")


@query("spl_shuffle_blocks", f"""WITH r AS (SELECT event_id, CAST(event_id // 500 AS BIGINT) AS block, row_number() OVER (PARTITION BY event_id // 500 ORDER BY {hi(42, 'event_id')}, event_id) AS k,
  count(*) OVER (PARTITION BY event_id // 500) AS n FROM events)
  SELECT event_id, block, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split FROM r""")
def _(t):
    return sp.shuffle_blocks(t.events.select("event_id"), "event_id", 500, W)


@query("spl_study", f"""WITH s AS (SELECT DISTINCT c_nationkey AS study FROM customer WHERE c_nationkey <> 7),
  r AS (SELECT study, row_number() OVER (ORDER BY {hi(42, 'study')}, study) AS k, count(*) OVER () AS n FROM s)
  SELECT c_custkey, c_nationkey AS study, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.9) THEN 'dev' ELSE 'test' END AS split
  FROM customer JOIN r ON study = c_nationkey""")
def _(t):
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("study"))
    return sp.split_studies(rows, "study", {"train": 0.8, "dev": 0.1, "test": 0.1}, drop=7)


@query("spl_source_cross", f"""SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2') THEN 'test' WHEN {hu(42, 'doc_id')} < 0.1 THEN 'dev' ELSE 'train' END AS split FROM documents""")
def _(t):
    return sp.split_cross_source(t.documents.select("doc_id", "source"), "source", ["src1", "src2"], ["doc_id"])


@query("spl_from_map", views("expr") + """SELECT cell_id, gene, CASE p_type WHEN 'PROMO' THEN 'dev' WHEN 'SMALL' THEN 'test' WHEN 'LARGE' THEN NULL ELSE 'train' END AS split FROM expr JOIN part ON CAST(p_partkey AS VARCHAR) = gene""")
def _(t):
    k = F.col("p_type")
    m = t.part.where(k != "LARGE").select(F.col("p_partkey").cast("string").alias("gene"),
                                          F.when(k == "PROMO", "val").when(k == "SMALL", "test").otherwise("train").alias("split"))
    return sp.split_from_map(t.expr.select("cell_id", "gene"), m, "gene").select("cell_id", "gene", "split")


@query("spl_from_parts", views("pobs") + """, s AS (SELECT cell_id, perturbation, CASE WHEN batch = 'F' THEN 'train' WHEN perturbation NOT LIKE '%Control%' THEN 'dev' END AS split FROM pobs)
  SELECT *, CASE split WHEN 'dev' THEN 'test' ELSE split END AS split_for_test FROM s""")
def _(t):
    rows, first = t.pobs.select("cell_id", "perturbation", "batch"), F.col("batch") == "F"
    parts = {"train": rows.where(first), "dev": rows.where(~first)}
    return sp.split_from_parts({n: df.drop("batch") for n, df in parts.items()}, F.col("perturbation").contains("Control"), {"dev": "test"})


@query("spl_disjoint_check", views("pobs") + """, b AS (SELECT DISTINCT batch AS split, 'before' AS stage, perturbation AS p FROM pobs UNION ALL
    SELECT DISTINCT batch, 'after', string_split(perturbation, '_')[1] FROM pobs)
  SELECT x.stage, x.split || '&' || y.split AS pair, count(*) AS n_shared FROM b x JOIN b y ON x.stage = y.stage AND x.p = y.p AND x.split < y.split GROUP BY 1, 2""")
def _(t):
    rows = t.pobs.withColumnRenamed("batch", "split")
    return sp.disjoint_check(rows, lambda c: F.split(c, "_")[0])


@query("spl_share_check", views("obs") + """SELECT batch AS split, count(*) AS n, round(count(*) / (SELECT count(*) FROM obs), 6) AS share,
  CASE batch WHEN 'F' THEN 0.33::DOUBLE WHEN 'O' THEN 0.4::DOUBLE WHEN 'P' THEN 0.27::DOUBLE END AS wanted,
  abs(count(*) / (SELECT count(*) FROM obs) - CASE batch WHEN 'F' THEN 0.33 WHEN 'O' THEN 0.4 WHEN 'P' THEN 0.27 END) <= 0.02 AS ok FROM obs GROUP BY 1""")
def _(t):
    out = sp.share_check(t.obs.withColumnRenamed("batch", "split"), {"F": 0.33, "O": 0.4, "P": 0.27}, 0.02)
    return rounded(out, "share")


@query("smp_n", views("obs") + f"SELECT cell_id, label FROM obs ORDER BY {hi(42, 'cell_id')}, cell_id LIMIT 3000")
def _(t):
    return sp.sample_n(t.obs.select("cell_id", "label"), 3000, ["cell_id"])


GROUPED = """, c AS (SELECT label, batch, cell_id, label || batch AS g FROM obs),
  r AS (SELECT g, cell_id, row_number() OVER (PARTITION BY g ORDER BY {h}, cell_id) AS rn, count(*) OVER (PARTITION BY g) AS n FROM c)"""


def grouped(t):
    return t.obs.select(F.concat("label", "batch").alias("g"), "cell_id")


@query("smp_n_per_group", views("obs") + GROUPED.format(h=hi(42, "cell_id")) + "SELECT g, cell_id FROM r WHERE rn <= 700 AND n >= 700")
def _(t):
    return sp.sample_n_per_group(grouped(t), 700, "g", ["cell_id"])


@query("smp_upto_n_per_group", views("obs") + GROUPED.format(h=hi(42, "cell_id")) + "SELECT g, cell_id FROM r WHERE rn <= 700")
def _(t):
    return sp.sample_upto_n_per_group(grouped(t), 700, "g", ["cell_id"])


@query("smp_fraction", views("obs") + f"SELECT cell_id FROM obs WHERE {hu(42, 'cell_id')} < 0.25")
def _(t):
    return sp.sample_fraction(t.obs.select("cell_id"), 0.25, ["cell_id"])


@query("smp_equal_quota", f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, least(l_suppkey // 7, 6) * 10 + l_linenumber % 3 AS g FROM lineitem),
  s AS (SELECT g, count(*) AS size FROM o GROUP BY 1), t AS (SELECT floor(sum(size) * 0.4)::BIGINT AS total FROM s),
  lv AS (SELECT max(l) AS lvl FROM range(0, 200000) r(l), t WHERE (SELECT 1) = 1 AND l <= (SELECT max(size) FROM s)
    AND (SELECT sum(least(size, l)) FROM s) <= total),
  q AS (SELECT g, size, least(size, lvl) AS base, size > lvl AS opn FROM s, lv),
  f AS (SELECT g, base + CASE WHEN opn AND row_number() OVER (ORDER BY opn DESC, size DESC, g) <= (SELECT total FROM t) - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
  r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {hi(42, 'l_orderkey', 'l_linenumber', 'l_partkey')}, l_orderkey, l_linenumber, l_partkey) AS rn FROM o)
  SELECT r.g, l_orderkey, l_linenumber, l_partkey FROM r JOIN f USING (g) WHERE rn <= quota""")
def _(t):
    g = F.least(F.floor(F.col("l_suppkey") / 7), F.lit(6)) * 10 + F.col("l_linenumber") % 3
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", g.alias("g"))
    return sp.sample_equal_quota(rows, "g", 0.4, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("smp_balanced_weights", views("obs") + f""", r AS (SELECT cell_id, label, row_number() OVER (PARTITION BY label ORDER BY {hi(42, 'cell_id')}, cell_id) AS rn FROM obs),
  l AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS l FROM obs GROUP BY 1),
  d AS (SELECT i AS draw, CAST(floor({hu('42l', 'i')} * (SELECT count(*) FROM l)) AS BIGINT) AS l, {hu('42r', 'i')} AS u FROM range(5000) x(i))
  SELECT draw, label, cell_id FROM d JOIN l USING (l) JOIN r USING (label) WHERE rn = floor(u * n) + 1""")
def _(t):
    return sp.sample_balanced(t.obs.select("cell_id", "label"), "label", 5000, ["cell_id"]).select("draw", "label", "cell_id")


_P = [0.36787944117144233]
for _i in range(1, 19):
    _P.append(_P[-1] / _i)
_CUM = []
for _x in _P:
    _CUM.append(_x + (_CUM[-1] if _CUM else 0))


@query("smp_bootstrap", views("obs") + f""", x AS (SELECT cell_id, run, {hu(42, 'run', 'cell_id')} AS u FROM obs, (SELECT unnest(range(3)) AS run)),
  y AS (SELECT cell_id, run, {' + '.join(f'(u >= {c!r}::DOUBLE)::INT' for c in _CUM[:18])} AS k FROM x)
  SELECT cell_id, CAST(run AS INTEGER) AS run, CAST(copy AS INTEGER) AS copy FROM y, LATERAL (SELECT unnest(range(1, k + 1)) AS copy) WHERE k > 0""")
def _(t):
    return sp.bootstrap(t.obs.select("cell_id"), 3, keys=["cell_id"])


@query("smp_weighted_mix", views("obs") + f"""SELECT cell_id, batch AS source FROM obs WHERE (batch = 'F') OR (batch = 'O' AND {hu('42O', 'cell_id')} < 0.5) OR (batch = 'P' AND {hu('42P', 'cell_id')} < 0.25)""")
def _(t):
    names = sorted(r[0] for r in t.obs.select("batch").distinct().collect())
    parts = {b: t.obs.where(F.col("batch") == b).select("cell_id") for b in names}
    return sp.weighted_mix(parts, {"F": 4.0, "O": 2.0, "P": 1.0}, ["cell_id"])


@query("smp_sparsify", views("expr") + f""", u AS (SELECT *, {hu(42, 'cell_id', 'gene')} AS u FROM expr)
  SELECT cell_id, gene, value FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY u DESC, gene) AS r FROM u) WHERE u >= 0.6 OR r = 1""")
def _(t):
    return sp.sparsify(t.expr, 0.6)


@query("smp_grid_subset", views("pexpr", "pobs") + """, p AS (SELECT DISTINCT perturbation FROM pobs WHERE perturbation <> 'Control' ORDER BY 1 LIMIT 12),
  g AS (SELECT DISTINCT gene FROM pexpr ORDER BY 1 LIMIT 9)
  SELECT cell_id, gene, value FROM pexpr JOIN pobs USING (cell_id) WHERE gene IN (SELECT gene FROM g) AND (perturbation = 'Control' OR perturbation IN (SELECT perturbation FROM p))""")
def _(t):
    return sp.grid_subset(t.pexpr, t.pobs, 12, 9)[0].select("cell_id", "gene", "value")


@query("smp_interleave_order", views("pobs") + f"""SELECT cell_id, perturbation, batch AS split, row_number() OVER (ORDER BY CASE WHEN perturbation = 'Control' THEN '' ELSE batch END,
  {hi(42, 'cell_id')}, cell_id) - 1 AS position FROM pobs""")
def _(t):
    rows = t.pobs.select("cell_id", "perturbation", F.col("batch").alias("split"))
    return sp.interleave_order(rows, ["cell_id"])

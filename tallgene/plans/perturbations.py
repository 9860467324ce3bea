"""Queries for perturbation pairing and scores."""

from pyspark.sql import functions as F

from tallgene.functions.rand import hash_int_sql as hi
from tallgene.functions.rand import hash_uniform_sql as hu
from tallgene.operators import perturb as pt
from tallgene.operators import stats as st
from tallgene.plans.aggregates import DE_SQL, GM_SQL, KEYED, keyed, psplit
from tallgene.plans.bind import views
from tallgene.plans.registry import query, rounded

CTRL = f"""ctl AS (SELECT cell_id AS control_id, row_number() OVER (ORDER BY {hi('42c', 'cell_id')}, cell_id) AS rn FROM pobs WHERE perturbation = 'Control'),
  pairs AS (SELECT cell_id, perturbation, control_id FROM pobs JOIN ctl ON rn = {hi(42, 'cell_id')} % (SELECT count(*) FROM ctl) + 1 WHERE perturbation <> 'Control')"""


@query("prt_pair_control", views("pobs")[:-1] + ", " + CTRL + " SELECT * FROM pairs")
def _(t):
    return pt.pair_control(t.pobs).select("cell_id", "perturbation", "control_id")


@query("prt_pair_cyclic", views("pobs")[:-1] + f""", ctl AS (SELECT cell_id AS control_id, row_number() OVER (ORDER BY {hi('42c', 'cell_id')}, cell_id) AS rn FROM pobs WHERE perturbation = 'Control'),
  c AS (SELECT cell_id, row_number() OVER (ORDER BY {hi('42p', 'cell_id')}, cell_id) - 1 AS i FROM pobs WHERE perturbation <> 'Control'),
  k AS (SELECT cell_id, i, CAST(i // 400 AS BIGINT) AS chunk FROM c)
  SELECT cell_id, chunk, control_id FROM k JOIN ctl ON rn = ({hi(42, 'chunk')} % (SELECT count(*) FROM ctl) + i % 400) % (SELECT count(*) FROM ctl) + 1""")
def _(t):
    return pt.pair_cyclic(t.pobs, 400).select("cell_id", "chunk", "control_id")


PAIRED = CTRL + """, raw AS (SELECT cell_id, gene, value AS label, 0 AS control, 0 AS target FROM pairs JOIN pexpr USING (cell_id)
    UNION ALL SELECT p.cell_id, e.gene, 0, e.value, 0 FROM pairs p JOIN pexpr e ON e.cell_id = p.control_id
    UNION ALL SELECT cell_id, unnest(string_split(perturbation, '_')), 0, 0, 1 FROM pairs),
  paired AS (SELECT cell_id, gene, sum(label) AS label, sum(control) AS control, max(target) AS perturbed FROM raw GROUP BY 1, 2)"""


def paired(t):
    return pt.paired_genes(pt.pair_control(t.pobs), t.pexpr)


@query("prt_expose_zeros", views("pexpr", "pobs")[:-1] + ", " + PAIRED + f""" SELECT 'label_nonzeros' AS mode, * FROM paired WHERE control <> 0 OR perturbed = 1 OR label <> 0
  UNION ALL SELECT 'no_zeros', * FROM paired WHERE control <> 0 OR perturbed = 1
  UNION ALL SELECT 'alternate', * FROM paired WHERE control <> 0 OR perturbed = 1 OR ({hu(42, 'cell_id')} >= 0.5 AND label <> 0)""")
def _(t):
    p, out = paired(t), None
    for mode in ("label_nonzeros", "no_zeros", "alternate"):
        one = pt.expose_zeros(p, mode).select(F.lit(mode).alias("mode"), "cell_id", "gene", "label", "control", "perturbed")
        out = one if out is None else out.unionByName(one)
    return out


ONCE = [(f" {name} AS (", f" {name} AS MATERIALIZED (") for name in ("pexpr", "pobs", "pairs", "raw", "paired")]


def once(sql: str) -> str:
    """The tables that several steps read are made once."""
    for name, held in ONCE:
        sql = sql.replace(name, held, 1)
    return sql


@query("prt_expose_zeros_all", once(views("pexpr", "pobs")[:-1] + ", " + PAIRED) + """ SELECT cell_id, gene, coalesce(label, 0) AS label, coalesce(control, 0) AS control, coalesce(perturbed, 0) AS perturbed
  FROM pairs CROSS JOIN (SELECT DISTINCT gene FROM pexpr) LEFT JOIN paired USING (cell_id, gene)""")
def _(t):
    return pt.expose_zeros(paired(t), "all", t.pexpr, t.pobs.where("perturbation <> 'Control'").select("cell_id"))


AVG = GM_SQL + """, av AS (SELECT gene, sum(mean) / (SELECT count(*) FROM tr) AS mean FROM m WHERE perturbation IN (SELECT perturbation FROM tr) GROUP BY 1),
  truth AS (SELECT perturbation, gene, mean FROM m UNION ALL SELECT 'Average_Perturbation_Train', gene, mean FROM av)"""


def truth(t):
    return st.group_means(t.pexpr, psplit(t))


@query("prt_pair_fields", views("pexpr", "pobs")[:-1] + ", " + PAIRED + AVG + """ SELECT cell_id, gene, control, perturbed, label, label - control AS delta,
  round(label - coalesce(mean, 0), 6) AS delta_baseline FROM paired LEFT JOIN av USING (gene) WHERE control <> 0 OR perturbed = 1 OR label <> 0""")
def _(t):
    avg = truth(t).where(F.col("perturbation") == st.AVERAGE)
    out = pt.pair_fields(pt.expose_zeros(paired(t), "label_nonzeros"), avg)
    return rounded(out.select("cell_id", "gene", "control", "perturbed", "label", "delta", "delta_baseline"), "delta_baseline")


@query("prt_grouped_truth", views("pexpr", "pobs") + GM_SQL + """ SELECT perturbation, gene, round(mean, 6) AS mean FROM m WHERE gene IN (SELECT gene FROM m GROUP BY 1 HAVING max(mean) > 0)""")
def _(t):
    return rounded(pt.grouped_truth(st.plain_group_means(t.pexpr, t.pobs, ["perturbation"]), True), "mean")


def ppred(t):
    """Predictions for the perturbed test cells, on the genes they have."""
    cells = t.pobs.where("batch = 'P' and perturbation <> 'Control'")
    return t.pexpr.join(cells, "cell_id").select(
        F.col("cell_id").alias("sample_id"), "perturbation", "gene", F.col("value").alias("label"),
        (F.col("value") * 0.5 + F.length("gene")).alias("predicted"), (F.col("value") * 0.25 - 3).alias("predicted_delta"))


PPRED = """ppred AS (SELECT cell_id AS sample_id, perturbation, gene, value AS label, value * 0.5 + length(gene) AS predicted, value * 0.25 - 3 AS predicted_delta
  FROM pexpr JOIN pobs USING (cell_id) WHERE batch = 'P' AND perturbation <> 'Control')"""


def grouped_sql(delta: bool) -> str:
    val = "baseline + coalesce(pm, 0)" if delta else "coalesce(pm, baseline)"
    col = "predicted_delta" if delta else "predicted"
    return AVG + ", " + PPRED + f""",
  bs AS (SELECT g.gene, coalesce(c.mean, 0) AS input, coalesce(av.mean, 0) AS baseline FROM (SELECT DISTINCT gene FROM truth) g
    LEFT JOIN (SELECT gene, mean FROM m WHERE perturbation = 'Control') c USING (gene) LEFT JOIN av USING (gene)),
  pm AS (SELECT perturbation, gene, avg({col}) AS pm FROM ppred GROUP BY 1, 2),
  grp AS (SELECT p.perturbation, bs.gene, {val} AS predicted, input, baseline, coalesce(m.mean, 0) AS label
    FROM (SELECT DISTINCT perturbation FROM ppred) p CROSS JOIN bs LEFT JOIN pm ON pm.perturbation = p.perturbation AND pm.gene = bs.gene
    LEFT JOIN m ON m.perturbation = p.perturbation AND m.gene = bs.gene)"""


G4 = "SELECT perturbation, gene, round(predicted, 6) AS predicted, round(input, 6) AS input, round(baseline, 6) AS baseline, round(label, 6) AS label FROM grp"


def grouped(t, delta=False):
    return pt.grouped_predictions(ppred(t), truth(t), delta)


@query("prt_grouped_pred", views("pexpr", "pobs") + grouped_sql(False) + G4)
def _(t):
    return rounded(grouped(t), "predicted", "input", "baseline", "label")


@query("prt_grouped_pred_delta", views("pexpr", "pobs") + grouped_sql(True) + G4)
def _(t):
    return rounded(grouped(t, True), "predicted", "input", "baseline", "label")


MET = """round(corr(predicted, label), 6) AS agg_pcc, round(corr(input, label), 6) AS baseline_agg_pcc, round(corr(baseline, label), 6) AS baseline_agg_pcc_from_avg,
  round(corr(predicted - input, label - input), 6) AS delta_agg_pcc, round(avg(abs(label - predicted)), 6) AS agg_mae, round(avg(abs(label - input)), 6) AS baseline_agg_mae,
  round(avg(abs(label - baseline)), 6) AS baseline_agg_mae_from_avg"""


@query("prt_agg_metrics", views("pexpr", "pobs") + grouped_sql(False) + f"SELECT perturbation, {MET} FROM grp GROUP BY 1")
def _(t):
    return rounded(pt.aggregated_metrics(grouped(t)), *pt.METRICS)


TOP = DE_SQL.replace(", n AS", ", dn AS").replace(" n AS (", " dn AS (").replace("FROM n ", "FROM dn n ").replace(" m AS (", " dm AS (").replace("FROM m a JOIN m c", "FROM dm a JOIN dm c").replace(
    " t AS (", " dt AS (").replace("FROM t)", "FROM dt)") + """, top20 AS (SELECT perturbation, gene FROM (SELECT perturbation, gene, row_number() OVER (PARTITION BY perturbation ORDER BY rank) AS pos
    FROM rk WHERE rank <= 50 AND mean <> 0) WHERE pos <= 20)"""


def top20(t):
    ranked = st.de_rank(st.de_scores(t.pexpr, t.pobs), 50)
    return st.de_nonzero_nondropout(ranked).where("kind = 'non_zero'")


@query("prt_top20_metrics", views("pexpr", "pobs") + grouped_sql(False) + TOP + f""", sub AS (SELECT grp.* FROM grp JOIN top20 USING (perturbation, gene)
    WHERE perturbation IN (SELECT perturbation FROM top20 JOIN grp USING (perturbation, gene) GROUP BY 1 HAVING count(*) >= 2)),
  one AS (SELECT perturbation, {MET.replace('round(', '(').replace(', 6) AS', ') AS')} FROM sub GROUP BY 1)
  SELECT perturbation, {', '.join(f'round({m}, 6) AS {m}' for m in pt.METRICS)} FROM one UNION ALL SELECT 'mean', {', '.join(f'round(avg({m}), 6)' for m in pt.METRICS)} FROM one""")
def _(t):
    return rounded(pt.top_gene_metrics(grouped(t), top20(t)).select("perturbation", *pt.METRICS), *pt.METRICS)


@query("prt_top20_delta", views("pexpr", "pobs") + AVG + ", " + PPRED + TOP + """, x AS (SELECT p.perturbation, p.gene, p.predicted - coalesce(c.mean, 0) AS a, p.label - coalesce(c.mean, 0) AS b
    FROM ppred p JOIN top20 USING (perturbation, gene) LEFT JOIN (SELECT gene, mean FROM m WHERE perturbation = 'Control') c ON c.gene = p.gene),
  l AS (SELECT perturbation, gene, 'predicted' AS kind, a AS x FROM x UNION ALL SELECT perturbation, gene, 'label', b FROM x)
  SELECT perturbation, gene, kind, round(avg(x), 6) AS mean, round(min(x), 6) AS low, round(quantile_cont(x, 0.25), 6) AS q1, round(median(x), 6) AS median,
    round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS high FROM l GROUP BY 1, 2, 3""")
def _(t):
    ctrl = st.plain_group_means(t.pexpr, t.pobs, ["perturbation"]).where("perturbation = 'Control'")
    out = pt.top_gene_deltas(ppred(t), top20(t), ctrl)
    return rounded(out, "mean", "low", "q1", "median", "q3", "high")


@query("prt_discrimination", views("pexpr", "pobs") + grouped_sql(False) + """, d AS (SELECT a.perturbation AS p, b.perturbation AS q, round(sum(abs(a.predicted - b.label)), 9) AS d
    FROM grp a JOIN grp b ON a.gene = b.gene WHERE NOT list_contains(string_split(a.perturbation, '_'), a.gene) GROUP BY 1, 2),
  o AS (SELECT p, d AS own FROM d WHERE p = q)
  SELECT p AS perturbation, count(*) FILTER (d < own) AS closer, round(1 - count(*) FILTER (d < own) / count(*), 6) AS score, round(any_value(own), 6) AS distance
  FROM d JOIN o USING (p) GROUP BY 1""")
def _(t):
    return rounded(pt.discrimination_scores(grouped(t)), "score", "distance")


@query("prt_delta_to_expr", views("pexpr", "pobs") + AVG + ", " + PPRED + """ SELECT sample_id, gene, round(coalesce(av.mean, 0) + predicted_delta, 6) AS predicted FROM ppred LEFT JOIN av USING (gene)""")
def _(t):
    return rounded(pt.add_predicted(ppred(t).drop("predicted"), truth(t)).select("sample_id", "gene", "predicted"), "predicted")


@query("prt_fill_matrix", views("pexpr", "pobs") + grouped_sql(False) + """SELECT s.sample_id, s.perturbation, grp.gene, round(coalesce(o.predicted, grp.predicted), 6) AS value
  FROM (SELECT DISTINCT sample_id, perturbation FROM ppred) s JOIN grp USING (perturbation) LEFT JOIN ppred o ON o.sample_id = s.sample_id AND o.gene = grp.gene""")
def _(t):
    return rounded(pt.fill_matrix(ppred(t), grouped(t)), "value")


@query("prt_scaled_score", """WITH s AS (SELECT p_brand AS model, avg(p_size) / 1000 AS mae, avg(p_retailprice) / 2000 AS des, avg(p_size) / 50 AS pds FROM part GROUP BY 1),
  x AS (SELECT model, greatest(0, (0.028 - mae) / 0.028) AS a, greatest(0, des) AS b, greatest(0, (pds - 0.5116) / (1 - 0.5116)) AS c FROM s)
  SELECT model, round(a, 6) AS scaled_mae, round(b, 6) AS scaled_des, round(c, 6) AS scaled_pds, round((a + b + c) / 3 * 100, 6) AS final_score FROM x""")
def _(t):
    s = t.part.groupBy(F.col("p_brand").alias("model")).agg(
        (F.avg("p_size") / 1000).alias("mae"), (F.avg("p_retailprice") / 2000).alias("des"), (F.avg("p_size") / 50).alias("pds"))
    out = pt.scaled_scores(s).drop("mae", "des", "pds")
    return rounded(out, "scaled_mae", "scaled_des", "scaled_pds", "final_score")


R2 = views("pexpr", "pobs")[:-1] + ", " + KEYED + """, n AS (SELECT key, count(*) AS n FROM k GROUP BY 1), g AS (SELECT DISTINCT gene FROM pexpr),
  s AS (SELECT key, gene, sum(value) / any_value(n) AS y FROM pexpr JOIN k USING (cell_id) JOIN n USING (key) GROUP BY 1, 2),
  cn AS (SELECT substr(cell_type, 3) AS ct, count(*) AS n FROM pobs WHERE perturbation = 'Control' GROUP BY 1),
  c AS (SELECT substr(cell_type, 3) AS ct, gene, sum(value) / any_value(n) AS p FROM pexpr JOIN pobs USING (cell_id) JOIN cn ON cn.ct = substr(cell_type, 3) WHERE perturbation = 'Control' GROUP BY 1, 2),
  d AS (SELECT n.key, g.gene, coalesce(y, 0) AS y, coalesce(p, 0) AS p FROM n CROSS JOIN g LEFT JOIN s ON s.key = n.key AND s.gene = g.gene
    LEFT JOIN c ON c.ct = string_split(n.key, '_')[1] AND c.gene = g.gene),
  e AS (SELECT key, sum((y - p) * (y - p)) AS sc, sum(y * y) AS sz, sum(y * y) - sum(y) * sum(y) / count(*) AS st FROM d GROUP BY 1),
  r2 AS (SELECT 'control' AS model, key, 1 - sc / st AS r2 FROM e WHERE st > 0 UNION ALL SELECT 'zero', key, 1 - sz / st FROM e WHERE st > 0)"""


def r2(t):
    k = keyed(t).select("cell_id", "key")
    ctrl = st.control_means(t.pexpr, t.pobs.withColumn("cell_type", F.expr("substr(cell_type, 3)")))
    return {"control": pt.r2_by_key(t.pexpr, k, ctrl), "zero": pt.r2_by_key(t.pexpr, k)}


@query("prt_r2_by_key", R2 + "SELECT model, key, round(r2, 5) AS r2 FROM r2")
def _(t):
    both = r2(t)
    out = both["control"].withColumn("model", F.lit("control")).unionByName(both["zero"].withColumn("model", F.lit("zero")))
    return rounded(out.where("r2 is not null"), "r2", digits=5)


@query("prt_assemble_results", R2 + """SELECT model, key AS combination, string_split(key, '_')[1] AS cell_line, string_split(key, '_')[2] AS drug,
  CAST(string_split(key, '_')[3] AS DOUBLE) * 10 AS dose, round(greatest(r2, 0), 5) AS r2 FROM r2""")
def _(t):
    return rounded(pt.assemble_results(r2(t), clamp=True).where("r2 is not null"), "r2", digits=5)


@query("prt_r2_summary", R2 + """SELECT model, CAST(string_split(key, '_')[3] AS DOUBLE) * 10 AS dose, round(median(r2), 4) AS median, round(avg(r2), 4) AS mean,
  round(avg(greatest(r2, 0)), 4) AS mean_clamped FROM r2 GROUP BY 1, 2""")
def _(t):
    return pt.r2_summary(pt.assemble_results(r2(t)).where("r2 is not null"))

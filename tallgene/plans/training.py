"""Queries for training-example tables."""

from pyspark.sql import functions as F

from tallgene.functions.rand import hash_uniform_sql as hu
from tallgene.operators import examples as ex
from tallgene.operators import harmonise as hz
from tallgene.operators import metrics as mt
from tallgene.operators import samples as sm
from tallgene.plans.bind import views
from tallgene.plans.registry import query, rounded
from tallgene.plans.sets import VOCAB, vocabulary

EV = views("expr")[:-1] + ", " + VOCAB


def tokens(t):
    """Gene tokens; genes divisible by 17 are unknown to the vocabulary."""
    g = F.col("gene").cast("bigint")
    name = F.when(g % 17 == 0, F.concat(F.lit("q"), "gene")).otherwise(F.concat(F.lit("g"), "gene"))
    return t.expr.select("cell_id", name.alias("token"), "value")


TOKENS = """, tk AS (SELECT cell_id, CASE WHEN CAST(gene AS BIGINT) % 17 = 0 THEN 'q' ELSE 'g' END || gene AS token, value FROM expr),
  ids AS (SELECT cell_id, token, value, coalesce(local_id, 0)::INTEGER AS token_id, coalesce(global_id, 0)::INTEGER AS gid
    FROM tk LEFT JOIN (SELECT token, local_id, global_id FROM vocab WHERE field = 'genes') USING (token))"""


@query("mat_tokens_to_ids", EV + TOKENS + "SELECT cell_id, token, token_id, gid AS global_id FROM ids")
def _(t):
    v = vocabulary(t)
    a = ex.tokens_to_ids(tokens(t), v, "genes", "token")
    return ex.tokens_to_ids(a, v, "genes", "token", "global_id", "global_id").select("cell_id", "token", "token_id", "global_id")


@query("mat_ids_to_tokens", EV + TOKENS + "SELECT cell_id, gid AS global_id, field, v.token, local_id FROM ids JOIN vocab v ON gid = global_id")
def _(t):
    ids = ex.tokens_to_ids(tokens(t), vocabulary(t), "genes", "token", "global_id", "global_id").select("cell_id", "global_id")
    return ex.ids_to_tokens(ids, vocabulary(t)).select("cell_id", "global_id", "field", "token", "local_id")


@query("mat_token_values", f"""WITH {VOCAB} SELECT field, token, local_id, CASE WHEN field = 'expressions' THEN TRY_CAST(token AS DOUBLE) END AS value FROM vocab""")
def _(t):
    v = vocabulary(t)
    one = [ex.token_values(v, f).withColumn("field", F.lit(f)) for f in ("genes", "expressions")]
    return one[0].unionByName(one[1]).select("field", "token", "local_id", "value")


def framed(t):
    ids = ex.tokens_to_ids(tokens(t), vocabulary(t), "genes", "token")
    one = ids.groupBy("cell_id").agg(F.sort_array(F.collect_list("token_id")).alias("ids"))
    return one.withColumn("batch_id", F.floor(F.col("cell_id").cast("bigint") / 8))


FRAMED = TOKENS + """, s AS (SELECT cell_id, CAST(cell_id AS BIGINT) // 8 AS batch_id, token_id, row_number() OVER (PARTITION BY cell_id ORDER BY token_id) AS k FROM ids),
  bd AS (SELECT * FROM s WHERE k <= 6), n AS (SELECT cell_id, batch_id, count(*) + 2 AS n FROM bd GROUP BY 1, 2),
  l AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY batch_id) / 4) * 4 AS BIGINT) AS len FROM n),
  fr AS (SELECT cell_id, batch_id, k AS pos, token_id AS id, 1 AS attention FROM bd UNION ALL SELECT cell_id, batch_id, 0, 3, 1 FROM n UNION ALL SELECT cell_id, batch_id, n - 1, 1, 1 FROM n
    UNION ALL SELECT cell_id, batch_id, unnest(range(n, len)), 2, 0 FROM l)"""


@query("mat_pad_frame", EV + FRAMED + "SELECT cell_id, batch_id, CAST(pos AS INTEGER) AS pos, CAST(id AS INTEGER) AS id, attention FROM fr")
def _(t):
    out = ex.pad_frame(framed(t), 3, 1, 2, 8, multiple=4)
    z = F.arrays_zip("ids", "attention")
    return out.select("cell_id", "batch_id", F.posexplode(z).alias("pos", "z")).select("cell_id", "batch_id", "pos", F.col("z.ids").alias("id"), "z.attention")


@query("mat_unk_rate", EV + TOKENS + """, a AS (SELECT cell_id, avg((token_id = 0)::INT) AS r FROM ids GROUP BY 1 UNION ALL SELECT 'total', avg((token_id = 0)::INT) FROM ids)
  SELECT cell_id, round(r, 6) AS unk_rate, r <= 0.1 AS ok FROM a""")
def _(t):
    return rounded(ex.unknown_rate(ex.tokens_to_ids(tokens(t), vocabulary(t), "genes", "token"), 0, 0.1), "unk_rate")


@query("mat_pretrained_align", f"""WITH {VOCAB}, v AS (SELECT 'g' || (vec_id * 7) AS token, vec_id AS position FROM embeddings)
  SELECT token, position, local_id AS freeze_id FROM v JOIN vocab USING (token) WHERE field = 'genes'""")
def _(t):
    vec = t.embeddings.select(F.concat(F.lit("g"), (F.col("vec_id") * 7).cast("string")).alias("token"), F.col("vec_id").alias("position"))
    return ex.align_pretrained(vec, vocabulary(t), "genes")


@query("mat_label_ids", views("obs") + """SELECT cell_id, CASE WHEN label IS NULL OR label = '5-LOW' OR lab = 'unseen' THEN -100 WHEN label = '1-URGENT' THEN 0 WHEN label = '2-HIGH' THEN 1 WHEN label = '3-MEDIUM' THEN 2 ELSE 3 END AS label_id,
  CASE WHEN batch = 'F' THEN -100 ELSE score END AS label_value FROM (SELECT *, CASE WHEN cell_id LIKE '%7' THEN 'unseen' ELSE label END AS lab FROM obs)""")
def _(t):
    o = t.obs
    d = hz.label_dictionary(o, ["label"])
    cells = o.withColumn("label", F.when(F.col("cell_id").endswith("7"), "unseen").otherwise(F.col("label")))
    a = ex.label_ids(cells, d, "label", silent=("5-LOW",))
    a = a.withColumn("score", F.when(F.col("batch") == "F", F.lit(None)).otherwise(F.col("score")))
    return ex.label_ids(a, d, "score", regression=True).select("cell_id", "label_id", "label_value")


@query("mat_label_multihot", views("pobs") + """, l AS (SELECT list_sort(list(DISTINCT p_brand)) AS l FROM part WHERE p_brand <> 'Brand#9')
  SELECT cell_id, array_to_string(list_transform(l, lambda x: list_contains(string_split(perturbation, '_'), x)::INT), '') AS multihot FROM pobs, l""")
def _(t):
    names = sorted(f"Brand#{i}" for i in range(1, 26) if i != 9)
    out = ex.label_multihot(t.pobs, names, "perturbation", "_")
    return out.select("cell_id", F.array_join(F.col("multihot").cast("array<string>"), "").alias("multihot"))


MASKIN = TOKENS + """, e AS (SELECT cell_id, CAST(cell_id AS BIGINT) // 16 AS batch_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY token) - 1 AS INTEGER) AS pos, token_id, CAST(value AS BIGINT) AS v FROM ids),
  x AS (SELECT cell_id, batch_id, pos, 'genes' AS field, token_id, pos = 0 AS special, 1.0 + token_id % 3 AS weight FROM e
    UNION ALL SELECT cell_id, batch_id, pos, 'expressions', CAST(5 + v % 10 AS INTEGER), pos = 0, 1.0 FROM e)"""


def mask_rows(t):
    from pyspark.sql import Window

    ids = ex.tokens_to_ids(tokens(t), vocabulary(t), "genes", "token")
    pos = F.row_number().over(Window.partitionBy("cell_id").orderBy("token")) - 1
    e = ids.withColumns({"pos": pos, "batch_id": F.floor(F.col("cell_id").cast("bigint") / 16)})
    fields = F.explode(F.array(
        F.struct(F.lit("genes").alias("field"), F.col("token_id").alias("id"), (1.0 + F.col("token_id") % 3).alias("weight")),
        F.struct(F.lit("expressions").alias("field"), (5 + F.col("value").cast("bigint") % 10).cast("int").alias("id"), F.lit(1.0).alias("weight"))))
    return e.select("cell_id", "batch_id", "pos", fields.alias("f")).select(
        "cell_id", "batch_id", "pos", "f.field", F.col("f.id").alias("token_id"), (F.col("pos") == 0).alias("special"), "f.weight")


def mask_sql(comask: bool) -> str:
    w = "weight" if comask else "CASE WHEN max((token_id IN (4, 0))::INT) OVER (PARTITION BY cell_id, pos) = 1 THEN 0 ELSE weight END"
    keys = ("cell_id", "pos") if comask else ("cell_id", "pos", "field")
    return f""", w AS (SELECT *, ({w})::DOUBLE AS w FROM x), p AS (SELECT *, CASE WHEN special THEN 0 ELSE least(1, w * 0.15 / avg(w) OVER (PARTITION BY batch_id, field)) END AS p, {hu(0, *keys)} AS u FROM w)
  SELECT cell_id, batch_id, pos, field, CAST(CASE WHEN u <= p * 0.8 THEN 4 WHEN u <= p * (0.8 + 0.1) THEN 5 + floor({hu('0t', 'cell_id', 'pos', 'field')} * 95) ELSE token_id END AS INTEGER) AS input_id,
    CASE WHEN u <= p THEN token_id END AS label_id FROM p"""


@query("mat_mask", EV + MASKIN + mask_sql(False))
def _(t):
    return ex.mask_tokens(mask_rows(t), 0.15, 0.8, 0.1, 4, 0, 5, 100)


@query("mat_mask_comask", EV + MASKIN + mask_sql(True))
def _(t):
    return ex.mask_tokens(mask_rows(t), 0.15, 0.8, 0.1, 4, 0, 5, 100, comask=True)


@query("mat_mask_pattern_weights", f"""WITH {VOCAB} SELECT token, local_id, CASE WHEN regexp_matches(token, '^(?:g1)') THEN 2.0::DOUBLE ELSE 1 END
  * CASE WHEN regexp_matches(token, '^(?:g[0-9]*5$)') THEN 0.5::DOUBLE ELSE 1 END AS weight FROM vocab WHERE field = 'genes'""")
def _(t):
    return ex.pattern_weights(vocabulary(t), [("g1", 2.0), ("g[0-9]*5$", 0.5)]).select("token", "local_id", "weight")


@query("mat_mask_adaptive", views("pred") + """, e AS (SELECT gene, avg(abs(predicted - label)) AS err FROM pred GROUP BY 1),
  d AS (SELECT gene, err AS a, max(err) OVER () - err AS b FROM e), r AS (SELECT min(a) la, (max(a) - min(a)) / 10 wa, min(b) lb, (max(b) - min(b)) / 10 wb FROM d)
  SELECT gene, round((least(greatest(ceil((a - la) / wa) - 1, 0), 9) + 1) / 11, 6) AS weight, round((least(greatest(ceil((b - lb) / wb) - 1, 0), 9) + 1) / 11, 6) AS weight_down FROM d, r""")
def _(t):
    e = mt.gene_errors(t.pred).select("gene", "gene_err")
    down = ex.adaptive_weights(e, "gene_err", 10, decreasing=True).select("gene", F.col("weight").alias("weight_down"))
    return rounded(ex.adaptive_weights(e, "gene_err", 10).select("gene", "weight").join(down, "gene"), "weight", "weight_down")


@query("mat_wced_labels", views("expr") + """, k AS (SELECT cell_id, gene FROM expr QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY gene) <= 2)
  SELECT 'input' AS label_set, expr.* FROM expr SEMI JOIN k USING (cell_id, gene) UNION ALL SELECT 'non_input', expr.* FROM expr ANTI JOIN k USING (cell_id, gene) UNION ALL SELECT 'all', expr.* FROM expr""")
def _(t):
    kept = sm.item_rows(sm.truncate(sm.build_samples(t.expr), 2))
    parts = [ex.wced_labels(t.expr, kept, s).select(F.lit(s).alias("label_set"), "cell_id", "gene", "value") for s in ("input", "non_input", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

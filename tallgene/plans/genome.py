"""Queries for sequences, variants, contact labels and interval joins."""

from pyspark.sql import functions as F

from tallgene.functions.lineage import stable
from tallgene.functions.rand import hash_int_sql as hi
from tallgene.functions.rand import hash_uniform_sql as hu
from tallgene.operators import intervals as iv
from tallgene.operators import sequence as sq
from tallgene.plans.bind import TILE, views
from tallgene.plans.registry import query, rounded

S = views("seqs")[:-1]


def chunk_cte(name: str, size: int) -> str:
    return f"""{name} AS (SELECT chrom, i AS chunk, substr(seq, i * {size} + 1, {size}) AS seq FROM seqs,
    LATERAL (SELECT unnest(range(0, (length(seq) + {size - 1}) // {size})) AS i))"""


RC = "reverse(translate(regexp_replace({0}, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"


@query("seq_cleanup", """SELECT doc_id, translate(text, 'URYKMSWBHVD', 'NNNNNNNNNNN') AS seq FROM documents""")
def _(t):
    return t.documents.select("doc_id", sq.cleanup("text").alias("seq"))


@query("seq_collapse_n", S + " SELECT chrom, regexp_replace(regexp_replace(seq, 'N+', 'N', 'g'), '#+', '#', 'g') AS seq FROM seqs")
def _(t):
    return t.seqs.select("chrom", sq.collapse_n("seq").alias("seq"))


@query("seq_revcomp", S + f" SELECT chrom, {RC.format('seq')} AS seq FROM seqs")
def _(t):
    return t.seqs.select("chrom", sq.reverse_complement("seq").alias("seq"))


@query("seq_chunk_fixed", S + ", " + chunk_cte("c", 128) + f" SELECT chrom, chunk, seq, {RC.format('seq')} AS rc FROM c WHERE NOT regexp_matches(seq, '^N+$')")
def _(t):
    return sq.chunk_tiles(t.tiles, 128, reverse=True).select("chrom", "chunk", "seq", "rc")


@query("seq_chunk_random", S + f""", k AS (SELECT chrom, seq, k, (1 + floor({hu(42, 'chrom', 'k')} * 4)) * 50 AS size FROM seqs, LATERAL (SELECT unnest(range(0, (length(seq) + 49) // 50)) AS k)),
  c AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY chrom ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k)
  SELECT chrom, CAST(k AS INTEGER) AS k, start, substr(seq, start + 1, CAST(size AS BIGINT)) AS seq FROM c WHERE start < length(seq) AND NOT regexp_matches(substr(seq, start + 1, CAST(size AS BIGINT)), '^N+$')""")
def _(t):
    return sq.chunk_random(t.tiles, TILE, 1, 4, 50)


ISL = """, run AS (SELECT chrom, seq, unnest(regexp_extract_all(seq, 'N+|[^N]+')) AS run, generate_subscripts(regexp_extract_all(seq, 'N+|[^N]+'), 1) AS i FROM seqs),
  at AS (SELECT chrom, seq, run, CAST(coalesce(sum(length(run)) OVER (PARTITION BY chrom ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n0 FROM run),
  isl AS (SELECT chrom, seq, n0, n0 + length(run) AS n1 FROM at WHERE run LIKE 'N%' AND length(run) >= 40),
  seqn AS (SELECT *, lag(n1) OVER (PARTITION BY chrom ORDER BY n0) AS p1, lead(n0) OVER (PARTITION BY chrom ORDER BY n0) AS nx FROM isl)"""


@query("seq_remove_n_islands", S + ISL.replace(" at AS", " plc AS").replace("FROM at", "FROM plc") + """, iv AS (SELECT chrom, seq, coalesce(p1 - 10, 0) AS start, n0 + 10 AS "end" FROM seqn WHERE n0 > 0
    UNION ALL SELECT chrom, seq, n1 - 10, length(seq) FROM seqn WHERE nx IS NULL AND n1 < length(seq)
    UNION ALL SELECT chrom, seq, 0, length(seq) FROM seqs WHERE length(seq) > 0 AND chrom NOT IN (SELECT chrom FROM isl))
  SELECT chrom, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", substr(seq, start + 1, "end" - start) AS seq FROM iv""")
def _(t):
    return sq.remove_n_islands(t.tiles, TILE, 40, 10).select("chrom", "start", "end", "seq")


DOMS = """, dom AS (SELECT DISTINCT 'd' || l_partkey AS chrom, l_linenumber * 150 AS start, l_linenumber * 150 + 90 AS "end" FROM lineitem),
  dm AS (SELECT dom.*, seq FROM dom JOIN seqs USING (chrom) WHERE "end" <= length(seq)),
  ed AS (SELECT chrom, any_value(seq) AS seq, min(start) AS a, max("end") AS b FROM dm GROUP BY 1)"""


def domains(t, sizes):
    d = t.lineitem.select(F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("chrom"),
                          (F.col("l_linenumber") * 150).cast("bigint").alias("start"), (F.col("l_linenumber") * 150 + 90).cast("bigint").alias("end")).distinct()
    return d.join(sizes, "chrom").where(F.col("end") <= F.col("len"))


@query("seq_cut_intervals", S + DOMS + """, iv AS (SELECT chrom, seq, start, "end" FROM dm UNION ALL SELECT chrom, seq, 0, a FROM ed WHERE a <> 0 UNION ALL SELECT chrom, seq, b, length(seq) FROM ed WHERE b <> length(seq))
  SELECT chrom, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", substr(seq, start + 1, "end" - start) AS seq FROM iv""")
def _(t):
    sizes = stable(sq.tile_lengths(t.tiles))
    cuts = sq.domain_intervals(stable(domains(t, sizes)), sizes)
    return sq.extract(t.tiles, cuts, TILE, sizes).select("chrom", "start", "end", "seq")


@query("seq_cut_intervals_binned", S + DOMS + """, iv AS (SELECT chrom, seq, CAST(start // 100 * 100 AS BIGINT) AS start, CAST("end" // 100 * 100 AS BIGINT) AS "end" FROM dm)
  SELECT DISTINCT chrom, start, "end", substr(seq, start + 1, "end" - start) AS seq FROM iv WHERE "end" > start""")
def _(t):
    sizes = stable(sq.tile_lengths(t.tiles))
    cuts = sq.domain_intervals(domains(t, sizes), None, resolution=100).distinct()
    return sq.extract(t.tiles, cuts, TILE, sizes).select("chrom", "start", "end", "seq")


SITES = """, st AS (SELECT 'd' || event_id % (SELECT count(*) FROM documents) AS chrom, event_id AS id, CAST(floor(value * 5) AS BIGINT) AS p, CASE WHEN event_type IN ('click', 'view') THEN '+' ELSE '-' END AS strand FROM events)"""


def sites(t):
    n = t.documents.select(F.count("*")).scalar()
    strand = F.when(F.col("event_type").isin("click", "view"), "+").otherwise("-")
    p = F.floor(F.col("value") * 5)
    return t.events.select(F.concat(F.lit("d"), (F.col("event_id") % n).cast("string")).alias("chrom"), F.col("event_id").alias("id"),
                           p.alias("start"), (p + 60).alias("end"), strand.alias("strand"))


@query("seq_extract_window", S + SITES + f""", w AS (SELECT id, strand, seq, greatest(0, p - CASE WHEN strand = '+' THEN 200 ELSE 40 END) AS a, p + 60 + CASE WHEN strand = '+' THEN 40 ELSE 200 END AS b FROM st JOIN seqs USING (chrom)),
  x AS (SELECT id, strand, substr(seq, a + 1, b - a) AS s FROM w WHERE a < length(seq))
  SELECT id, strand, CASE WHEN strand = '-' THEN {RC.format('s')} ELSE s END AS seq FROM x""")
def _(t):
    return sq.extract_stranded(t.tiles, sq.promoter_windows(sites(t)), TILE).select("id", "strand", "seq")


@query("seq_extract_window_center", S + SITES + """, w AS (SELECT id, seq, (p + p + 60) // 2 - 150 AS a FROM st JOIN seqs USING (chrom))
  SELECT id, substr(seq, a + 1, 300) AS seq FROM w WHERE a >= 0 AND a < length(seq)""")
def _(t):
    spans = sq.window_about(sites(t), 300).where("start >= 0")
    return sq.extract(t.tiles, spans, TILE).select("id", "seq")


@query("seq_split_variant", """SELECT doc_id, regexp_matches(text, '[^ACGTN]') AS is_variant FROM documents""")
def _(t):
    return t.documents.select("doc_id", sq.has_variant("text").alias("is_variant"))


@query("seq_mismatch", S + """, p AS (SELECT chrom, seq, reverse(seq) AS r FROM seqs WHERE length(seq) > 0)
  SELECT chrom, round(len(list_filter(list_zip(string_split(seq, ''), string_split(r, '')), lambda z: z[1] <> z[2])) / length(seq), 6) AS mismatch,
    len(list_filter(list_zip(string_split(seq, ''), string_split(r, '')), lambda z: z[1] <> z[2])) / length(seq) > 0.7 AS flagged FROM p""")
def _(t):
    s = t.seqs.where(F.length("seq") > 0).withColumn("mismatch", sq.mismatch_share("seq", F.reverse("seq")))
    return rounded(s.select("chrom", "mismatch", (F.col("mismatch") > 0.7).alias("flagged")), "mismatch")


@query("seq_match_merge", S + ", " + chunk_cte("c", 24) + """, l AS (SELECT DISTINCT seq, length(regexp_replace(seq, 'N', '', 'g')) AS label FROM c WHERE length(regexp_replace(seq, 'N', '', 'g')) > 6)
  SELECT chrom, chunk, seq, label FROM c JOIN l USING (seq) WHERE NOT regexp_matches(seq, '^N+$')""")
def _(t):
    c = sq.chunk_tiles(t.tiles, 24)
    labelled = c.select("seq").distinct().withColumn("label", F.length(F.regexp_replace("seq", "N", "")).cast("bigint")).where("label > 6")
    return sq.match_merge(c.select("chrom", "chunk", "seq"), labelled)


@query("seq_random_substitute", S + f""", o AS (SELECT 'd' || doc_id AS chrom, n_chars % 9 AS k FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
  pool AS (SELECT row_number() OVER (ORDER BY {hi('42o', 'chrom')}, chrom) AS rn, k AS k0 FROM o),
  n AS (SELECT chrom, seq, length(seq) AS n, CAST(least(length(seq), greatest(0, round_even(k0 + 0.3 * sqrt(-2 * ln(1 - {hu('42u', 'chrom')})) * cos(2 * 3.141592653589793 * {hu('42v', 'chrom')}), 0))) AS BIGINT) AS k
    FROM seqs JOIN pool ON rn = {hi('42d', 'chrom')} % (SELECT count(*) FROM o) + 1),
  f AS (SELECT chrom, seq, k, n, list_reduce(list_transform(range(n - k, n), lambda j: [j, CAST(floor({hu('42p', 'chrom', 'j')} * (j + 1)) AS BIGINT)]),
    lambda a, b: list_append(a, CASE WHEN list_contains(a, b[2]) THEN b[1] ELSE b[2] END), CAST([] AS BIGINT[])) AS ps FROM n),
  z AS (SELECT chrom, k, list_zip(string_split(seq, ''), range(0, n)) AS l, CASE WHEN k > 0 THEN ps ELSE [] END AS ps FROM f WHERE n > 0)
  SELECT chrom, CAST(k AS INTEGER) AS n_sub, array_to_string(list_transform(l, lambda x: CASE WHEN list_contains(ps, x[2]) THEN substr('XZJ', CAST(floor({hu('42l', 'chrom', 'x[2]')} * 3) AS BIGINT) + 1, 1) ELSE x[1] END), '') AS seq FROM z""")
def _(t):
    o = t.documents.join(t.labels.where("quality = 1"), "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), (F.col("n_chars") % 9).alias("k"))
    rows = sq.draw_counts(t.seqs.where(F.length("seq") > 0), o, "chrom")
    rows = rows.withColumn("n_sub", F.least("n_sub", F.length("seq")))
    return sq.random_substitute(rows, "XZJ", "chrom").select("chrom", "n_sub", "seq")


@query("seq_center_token", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents),
  u AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM w), c AS (SELECT doc_id, i, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS l FROM u)
  SELECT doc_id, CAST(coalesce(min(i) FILTER (l > 500) - 1, -1) AS INTEGER) AS center FROM c GROUP BY 1""")
def _(t):
    return t.documents.select("doc_id", sq.center_token(F.split("text", " ")).alias("center"))


RES = 100
CONTACT = """ct AS (SELECT 'd' || l_partkey AS chrom, (l_linenumber - 1)::BIGINT AS bin1, (l_linenumber + l_suppkey % 4)::BIGINT AS bin2, max(l_discount) * 7 AS oe FROM lineitem GROUP BY 1, 2, 3)"""
CH = S + ", " + chunk_cte("c", RES) + ", " + CONTACT


def contacts(t):
    return t.lineitem.groupBy(
        F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("chrom"), (F.col("l_linenumber") - 1).cast("bigint").alias("bin1"),
        (F.col("l_linenumber") + F.col("l_suppkey") % 4).alias("bin2")).agg((F.max("l_discount") * 7).alias("oe"))


def chunks(t):
    return sq.chunk_tiles(t.tiles, RES, drop_n=False)


PAIR = """, pr AS (SELECT a.chrom, a.chunk AS bin1, b.chunk AS bin2, a.seq AS seq1, b.seq AS seq2, (coalesce(oe, 0) <> 0)::INT::DOUBLE AS label FROM c a JOIN c b ON a.chrom = b.chrom AND b.chunk = a.chunk + 2
  LEFT JOIN ct ON ct.chrom = a.chrom AND ct.bin1 = a.chunk AND ct.bin2 = b.chunk WHERE NOT regexp_matches(a.seq || b.seq, '^N+$'))"""


@query("lab_contact_fixed", CH + PAIR + " SELECT * FROM pr")
def _(t):
    return sq.contact_fixed(chunks(t), contacts(t), stride=2)


@query("lab_contact_complete", S + ", " + CONTACT + f""", w AS (SELECT chrom, i AS bin1, i + 3 AS bin2, substr(seq, i * {RES} + 1, {4 * RES}) AS seq FROM seqs,
    LATERAL (SELECT unnest(range(0, (length(seq) - {3 * RES} + {RES - 1}) // {RES})) AS i) WHERE length(seq) > {3 * RES})
  SELECT w.chrom, w.bin1, w.bin2, seq, round(coalesce(oe, 0), 2) AS label FROM w LEFT JOIN ct USING (chrom, bin1, bin2) WHERE NOT regexp_matches(seq, '^N+$')""")
def _(t):
    return sq.contact_complete(t.tiles, contacts(t), sq.tile_lengths(t.tiles), RES, 3, TILE, binarize=False)


@query("seq_augment_pair", CH + PAIR + f""", v AS (SELECT chrom, bin1, seq1 AS a, seq2 AS b, reverse(seq1) AS ar, reverse(seq2) AS br, {RC.format('seq1')} AS arc, {RC.format('seq2')} AS brc FROM pr WHERE label = 1)
  SELECT chrom, bin1, 0 AS version, a || b AS seq FROM v UNION ALL SELECT chrom, bin1, 1, ar || b FROM v UNION ALL SELECT chrom, bin1, 2, a || br FROM v UNION ALL SELECT chrom, bin1, 3, ar || br FROM v
  UNION ALL SELECT chrom, bin1, 4, arc || b FROM v UNION ALL SELECT chrom, bin1, 5, a || brc FROM v UNION ALL SELECT chrom, bin1, 6, arc || brc FROM v""")
def _(t):
    p = sq.contact_fixed(chunks(t), contacts(t), stride=2).select("chrom", "bin1", "seq1", "seq2", F.col("label").alias("contact"))
    return sq.augment_pairs(p).select("chrom", "bin1", "version", "seq")


@query("lab_insulation", S + ", " + chunk_cte("c", RES) + f""", ins AS (SELECT 'd' || l_partkey AS chrom, (l_linenumber - 1) * {RES} AS start, CASE WHEN min(l_tax) > 0 THEN max(l_extendedprice) / 7000 END AS score FROM lineitem GROUP BY 1, 2)
  SELECT chrom, chunk, seq, round(score, 2) AS label FROM c JOIN ins USING (chrom) WHERE ins.start = c.chunk * {RES} AND score IS NOT NULL AND NOT regexp_matches(seq, '^N+$')""")
def _(t):
    table = t.lineitem.groupBy(F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("chrom"), ((F.col("l_linenumber") - 1) * RES).cast("bigint").alias("start")).agg(
        F.when(F.min("l_tax") > 0, F.max("l_extendedprice") / 7000).alias("score"))
    return sq.insulation_labels(chunks(t).withColumn("start", F.col("chunk") * RES), table).select("chrom", "chunk", "seq", "label")


@query("lab_contact_sequential", CH + """, k AS (SELECT DISTINCT chrom, bin1 // 4 AS w FROM ct WHERE oe <> 0 AND bin1 // 4 = bin2 // 4 AND bin1 < bin2),
  q AS (SELECT chrom, chunk // 4 AS w, string_agg(seq, '#' ORDER BY chunk) AS seqs FROM c GROUP BY 1, 2 HAVING count(*) = 4),
  ij AS (SELECT i, j FROM range(4) a(i), range(4) b(j) WHERE i < j)
  SELECT q.chrom, q.w AS "window", seqs, ij.i::INTEGER AS i, ij.j::INTEGER AS j, round(coalesce(oe, 0), 2) AS label FROM q JOIN k USING (chrom, w) CROSS JOIN ij
    LEFT JOIN ct ON ct.chrom = q.chrom AND ct.bin1 = q.w * 4 + ij.i AND ct.bin2 = q.w * 4 + ij.j""")
def _(t):
    out = sq.contact_sequential(chunks(t), contacts(t), 4)
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(i + 1, 4)])
    rows = out.select("chrom", "window", F.array_join("seqs", "#").alias("seqs"), F.explode(F.arrays_zip(at.alias("p"), "labels")).alias("z"))
    return rows.select("chrom", "window", "seqs", F.col("z.p.i").alias("i"), F.col("z.p.j").alias("j"), F.col("z.labels").alias("label"))


@query("lab_contact_random", CH + f""", f AS (SELECT chrom, chunk, row_number() OVER (PARTITION BY chrom ORDER BY {hi('0n', 'chunk')}, chunk) AS rn FROM c WHERE length(seq) = {RES} AND NOT regexp_matches(seq, '^N+$')),
  b AS (SELECT chrom, count(*) AS b FROM f GROUP BY 1 HAVING count(*) >= 4),
  s AS (SELECT chrom, b, unnest(range(0, CAST(floor(length(seq) // {4 * RES} * 1.0) AS BIGINT))) AS sample FROM seqs JOIN b USING (chrom)),
  d AS (SELECT chrom, sample, list_reduce(list_transform(range(b - 4, b), lambda j: [j, CAST(floor({hu('0p', "chrom || '/' || sample", 'j')} * (j + 1)) AS BIGINT)]),
    lambda x, y: list_append(x, CASE WHEN list_contains(x, y[2]) THEN y[1] ELSE y[2] END), CAST([] AS BIGINT[])) AS ps FROM s),
  e AS (SELECT chrom, sample, unnest(ps) AS r, generate_subscripts(ps, 1) - 1 AS pos FROM d),
  g AS (SELECT e.chrom, sample, pos, chunk FROM e JOIN f ON f.chrom = e.chrom AND f.rn = e.r + 1)
  SELECT x.chrom, CAST(x.sample AS INTEGER) AS sample, CAST(x.pos AS INTEGER) AS i, CAST(y.pos AS INTEGER) AS j, x.chunk AS bin_i, y.chunk AS bin_j, (coalesce(oe, 0) <> 0)::INT::DOUBLE AS label
  FROM g x JOIN g y ON x.chrom = y.chrom AND x.sample = y.sample AND x.pos < y.pos
    LEFT JOIN ct ON ct.chrom = x.chrom AND ct.bin1 = least(x.chunk, y.chunk) AND ct.bin2 = greatest(x.chunk, y.chunk)""")
def _(t):
    return sq.contact_random(chunks(t), contacts(t), sq.tile_lengths(t.tiles), RES, 4)


@query("lab_mpra_join", """SELECT l_orderkey, l_linenumber, l_partkey, l_partkey AS seq_id, p_retailprice AS mean_value, least(l_suppkey, l_linenumber) AS start, greatest(l_suppkey, l_linenumber) + 1 AS "end"
  FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type <> 'PROMO') ON p_partkey = l_partkey""")
def _(t):
    hits = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("seq_id"), F.col("l_suppkey").alias("sstart"), F.col("l_linenumber").alias("send"))
    labels = t.part.where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("seq_id"), F.col("p_retailprice").alias("mean_value"))
    return sq.measured_hits(hits, labels).select("l_orderkey", "l_linenumber", "l_partkey", "seq_id", "mean_value", "start", "end")


@query("lab_multi_combined", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey AS VARCHAR) AS dnase, l_linestatus AS histone FROM lineitem""")
def _(t):
    joined = F.concat_ws(",", F.col("l_suppkey").cast("string"), "l_returnflag", "l_linestatus")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", joined.alias("labels"))
    return sq.combined_labels(rows, "labels", ["dnase", "tf", "histone"], ["dnase", "histone"])


# variants every 20 letters of the whole text ------------------------------------------------------

STEP = 20
VARS = S + ", " + chunk_cte("vc", STEP) + f""", vr AS (SELECT vc.chrom, chunk * {STEP} + 5 AS pos, chunk, substr(vc.seq, 6, 1 + chunk % 3) AS ref FROM vc WHERE length(vc.seq) = {STEP}),
  fr AS (SELECT chrom, pos, ref, translate(ref, 'ACGTN', 'GTACA') AS alt1, CASE WHEN chunk % 2 = 0 THEN substr(ref, 1, 1) ELSE ref || 'TT' END AS alt2,
    'S1:' || CASE WHEN chunk % 11 = 0 THEN '.' ELSE '0.' || (50 + chunk % 40) END || ',0.' || (10 + chunk % 7) || ',' || CASE WHEN chunk % 5 = 0 THEN '.' ELSE '0.0' || (1 + chunk % 9) END
    || '|S2:' || CASE WHEN chunk % 11 = 0 THEN '.' ELSE '0.9' END || ',0.05,' || CASE WHEN chunk % 5 = 0 THEN '.' ELSE '0.05' END AS freq FROM vr)"""
PROB = VARS + """, pb AS (SELECT *, list_transform(string_split(freq, '|'), lambda s: list_transform(string_split(string_split(s, ':')[-1], ','), lambda p: CASE WHEN p = '.' THEN 0.0::DOUBLE ELSE CAST(p AS DOUBLE) END)) AS m FROM fr),
  pm AS (SELECT chrom, pos, ref, [ref, alt1, alt2] AS alleles, list_transform([1, 2, 3], lambda i: (m[1][i] + m[2][i]) / 2) AS probs FROM pb)"""
FIXED = PROB + """, fx AS (SELECT chrom, pos, ref, alleles, CASE WHEN probs[1] <= 0 THEN [1.0::DOUBLE, 0, 0] ELSE probs END AS probs FROM pm),
  al AS (SELECT chrom, pos, ref, unnest(alleles) AS allele, unnest(probs) AS prob, generate_subscripts(alleles, 1) AS k FROM fx), ok AS (SELECT * FROM al WHERE prob > 0)"""
SITE = FIXED + """, ex AS (SELECT chrom, pos + o AS pos, substr(allele, o + 1, 1) AS symbol, prob FROM ok, LATERAL (SELECT unnest(range(0, CASE WHEN length(allele) > length(ref) THEN length(ref) - 1 ELSE length(allele) END)) AS o)
    UNION ALL SELECT chrom, pos + o, 'DEL', prob FROM ok, LATERAL (SELECT unnest(range(length(allele), length(ref))) AS o) WHERE length(allele) < length(ref)
    UNION ALL SELECT chrom, pos + length(ref) - 1, substr(allele, length(ref), 1) || 'I', prob FROM ok WHERE length(allele) > length(ref)),
  sm AS (SELECT chrom, pos, symbol, sum(prob) AS p FROM ex GROUP BY 1, 2, 3),
  sc AS (SELECT chrom, pos, symbol, p / sum(p) OVER (PARTITION BY chrom, pos) AS prob FROM sm),
  ts AS (SELECT *, max(prob) OVER (PARTITION BY chrom, pos) <> 1 AS is_variant FROM sc),
  bs AS (SELECT chrom, unnest(range(0, length(seq))) AS pos, unnest(string_split(seq, '')) AS base FROM seqs WHERE length(seq) > 0),
  site AS (SELECT * FROM ts UNION ALL SELECT chrom, pos, base, 1.0, FALSE FROM bs ANTI JOIN ts USING (chrom, pos))"""


def variants(t):
    c = F.col("chunk")
    v = sq.chunk_tiles(t.tiles, STEP, drop_n=False).where(F.length("seq") == STEP).select(
        "chrom", (c * STEP + 5).alias("pos"), "chunk", F.substring(F.col("seq"), F.lit(6), (1 + c % 3).cast("int")).alias("ref"))
    alt2 = F.when(c % 2 == 0, F.substring("ref", 1, 1)).otherwise(F.concat("ref", F.lit("TT")))

    def n(x):
        return x.cast("string")

    freq = F.concat(F.lit("S1:"), F.when(c % 11 == 0, ".").otherwise(F.concat(F.lit("0."), n(50 + c % 40))), F.lit(",0."), n(10 + c % 7), F.lit(","),
                    F.when(c % 5 == 0, ".").otherwise(F.concat(F.lit("0.0"), n(1 + c % 9))),
                    F.lit("|S2:"), F.when(c % 11 == 0, ".").otherwise("0.9"), F.lit(",0.05,"), F.when(c % 5 == 0, ".").otherwise("0.05"))
    return v.select("chrom", "pos", "ref", F.array("ref", F.translate("ref", "ACGTN", "GTACA"), alt2).alias("names"), freq.alias("freq"))


def fixed(t):
    v = variants(t).withColumn("probs", sq.parse_freq("freq"))
    return v.select("chrom", "pos", "ref", sq.fix_reference("names", "probs").alias("alleles"))


@query("var_parse_freq", PROB + " SELECT chrom, pos, round(probs[1], 6) AS p0, round(probs[2], 6) AS p1, round(probs[3], 6) AS p2 FROM pm")
def _(t):
    p = variants(t).select("chrom", "pos", sq.parse_freq("freq").alias("p"))
    return rounded(p.select("chrom", "pos", *[F.col("p")[i].alias(f"p{i}") for i in range(3)]), "p0", "p1", "p2")


@query("var_ref_fix", FIXED + " SELECT chrom, pos, allele, round(prob, 6) AS prob FROM ok")
def _(t):
    return rounded(sq.each_allele(fixed(t), "chrom", "pos"), "prob")


CHECK = """ SELECT chrom, symbol, count(*) AS n, count(*) FILTER (is_variant) AS n_variant, round(sum(prob), 5) AS mass, round(sum(prob * (pos % 101)), 4) AS moment FROM {0} GROUP BY 1, 2"""


def summary(m):
    """Whole matrix, folded per chromosome and symbol to keep the result table small."""
    out = m.groupBy("chrom", "symbol").agg(F.count("*").alias("n"), F.count_if("is_variant").alias("n_variant"), F.sum("prob").alias("mass"),
                                           F.sum(F.col("prob") * (F.col("pos") % 101)).alias("moment"))
    return rounded(rounded(out, "mass", digits=5), "moment", digits=4)


@query("var_site_matrix", SITE + CHECK.format("site"))
def _(t):
    return summary(sq.site_matrix(t.tiles, fixed(t)))


@query("var_sites", SITE + " SELECT chrom, pos, symbol, round(prob, 6) AS prob, is_variant FROM ts")
def _(t):
    return rounded(sq.variant_sites(fixed(t)), "prob")


TOKEN = "A+|N+|[CGT]{1,4}"
TOKENS = f""", tc AS (SELECT chrom, chunk, FALSE AS reverse, length(seq) AS len, regexp_extract_all(seq, '{TOKEN}') AS t FROM c WHERE NOT regexp_matches(seq, '^N+$')
    UNION ALL SELECT chrom, chunk, TRUE, length(seq), regexp_extract_all({RC.format('seq')}, '{TOKEN}') FROM c WHERE NOT regexp_matches(seq, '^N+$')),
  tk AS (SELECT chrom, chunk, reverse, len, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM tc),
  tp AS (SELECT *, sum(length(token)) OVER (PARTITION BY chrom, chunk, reverse ORDER BY k) AS upto FROM tk),
  ta AS (SELECT *, chunk * 128 + CASE WHEN reverse THEN len - upto ELSE upto - length(token) END AS a FROM tp),
  vs AS (SELECT DISTINCT chrom, pos, pos // 128 AS chunk FROM ts WHERE is_variant),
  hit AS (SELECT DISTINCT chrom, chunk, reverse, k, 1 AS label FROM ta JOIN vs USING (chrom, chunk) WHERE pos >= a AND pos < a + length(token))
  SELECT chrom, chunk, reverse, string_agg(token, ' ' ORDER BY k) AS tokens, string_agg(CAST(coalesce(label, 0) AS VARCHAR), '' ORDER BY k) AS labels
  FROM ta LEFT JOIN hit USING (chrom, chunk, reverse, k) GROUP BY 1, 2, 3"""


@query("var_token_labels", SITE + ", " + chunk_cte("c", 128) + TOKENS)
def _(t):
    both = F.explode(F.array(F.struct(F.lit(False).alias("reverse"), F.col("seq").alias("s")), F.struct(F.lit(True).alias("reverse"), F.col("rc").alias("s"))))
    strands = sq.chunk_tiles(t.tiles, 128, reverse=True).select("chrom", "chunk", both.alias("b")).select("chrom", "chunk", "b.reverse", F.regexp_extract_all("b.s", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    out = sq.token_variant_labels(strands, sq.variant_sites(fixed(t)).where("is_variant").select("chrom", "pos"), 128)
    return out.select("chrom", "chunk", "reverse", F.array_join("tokens", " ").alias("tokens"), F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"))


@query("var_overlaps", FIXED + """, w AS (SELECT chrom, pos, ref, max(pos + length(ref)) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto
  FROM (SELECT chrom, pos, ref FROM fx UNION ALL SELECT chrom, pos + 1, ref FROM fx)) SELECT chrom, pos, ref FROM w WHERE pos < upto""")
def _(t):
    v = fixed(t).select("chrom", "pos", "ref")
    return sq.overlapping_variants(v.unionByName(v.withColumn("pos", F.col("pos") + 1)))


@query("var_revcomp_matrix", SITE + """, ln AS (SELECT chrom, length(seq) AS len FROM seqs), ins AS (SELECT chrom, pos, sum(prob) AS s FROM site JOIN ln USING (chrom) WHERE symbol IN ('AI', 'GI', 'TI', 'CI', 'NI') AND pos < len - 1 GROUP BY 1, 2),
  b AS (SELECT site.chrom, site.pos, site.symbol, prob / CASE WHEN a.s = 1 THEN 1 ELSE 1 - coalesce(a.s, 0) END * (1 - coalesce(p.s, 0)) AS prob FROM site
    LEFT JOIN ins a ON a.chrom = site.chrom AND a.pos = site.pos LEFT JOIN ins p ON p.chrom = site.chrom AND p.pos = site.pos - 1 WHERE symbol NOT IN ('AI', 'GI', 'TI', 'CI', 'NI')),
  m AS (SELECT chrom, pos, CASE WHEN symbol = 'DEL' THEN symbol ELSE translate(symbol, 'ACGT', 'TGCA') END AS symbol, prob FROM b
    UNION ALL SELECT ins.chrom, ins.pos + 1, translate(base, 'ACGT', 'TGCA') || 'I', s FROM ins JOIN bs ON bs.chrom = ins.chrom AND bs.pos = ins.pos + 1),
  r AS (SELECT m.chrom, len - 1 - pos AS pos, symbol, prob / sum(prob) OVER (PARTITION BY m.chrom, pos) AS prob FROM m JOIN ln USING (chrom) WHERE prob <> 0),
  rv AS (SELECT *, max(prob) OVER (PARTITION BY chrom, pos) <> 1 AS is_variant FROM r)""" + CHECK.format("rv"))
def _(t):
    return summary(sq.revcomp_matrix(sq.site_matrix(t.tiles, fixed(t)), t.tiles))


SYM = "['A', 'AI', 'C', 'CI', 'DEL', 'G', 'GI', 'N', 'NI', 'T', 'TI']"


def lexicon(t):
    """One letter per symbol pair, by a rule on the symbols' order."""
    names = sorted(sq.SYMBOLS)
    pairs = [(f"{a}_{b}", i * 11 + j) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    rows = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(chr(19968 + k)).alias("letter")) for p, k in pairs])
    return t.spark.range(1).select(F.explode(rows).alias("x")).select("x.*")


def sample_sql(replacement: bool) -> str:
    """Oracle of the allele draw; the second draw leaves the first symbol out unless drawn with replacement."""
    rest = "TRUE" if replacement else "a.symbol <> f.s1"
    return SITE + f""", cand AS (SELECT chrom, pos, symbol, prob, sum(prob) OVER w AS hi, sum(prob) OVER (PARTITION BY chrom, pos) AS tot, count(*) OVER (PARTITION BY chrom, pos) AS k, {hu('42a', 'chrom', 'pos')} AS u
    FROM ts WHERE is_variant WINDOW w AS (PARTITION BY chrom, pos ORDER BY symbol)),
  f AS (SELECT chrom, pos, arg_min(symbol, symbol) FILTER (u * tot < hi) AS s1 FROM cand WHERE k > 1 GROUP BY 1, 2),
  c2 AS (SELECT a.chrom, a.pos, a.symbol, s1, sum(a.prob) OVER (PARTITION BY a.chrom, a.pos ORDER BY a.symbol) AS hi, sum(a.prob) OVER (PARTITION BY a.chrom, a.pos) AS tot, {hu('42b', 'a.chrom', 'a.pos')} AS u
    FROM cand a JOIN f ON f.chrom = a.chrom AND f.pos = a.pos WHERE {rest}),
  g AS (SELECT chrom, pos, any_value(s1) AS s1, arg_min(symbol, symbol) FILTER (u * tot < hi) AS s2 FROM c2 GROUP BY 1, 2),
  pr AS (SELECT chrom, pos, least(s1, s2) AS x, greatest(s1, s2) AS y FROM g)"""


@query("var_sample_sites", sample_sql(False) + f""", ch AS (SELECT chrom, pos, chr(CAST(19968 + (list_position({SYM}, x) - 1) * 11 + list_position({SYM}, y) - 1 AS INTEGER)) AS letter FROM pr),
  z AS (SELECT bs.chrom, bs.pos // {TILE} AS tile, string_agg(coalesce(letter, base), '' ORDER BY bs.pos) AS seq FROM bs LEFT JOIN ch ON ch.chrom = bs.chrom AND ch.pos = bs.pos GROUP BY 1, 2)
  SELECT chrom, tile, tile * {TILE} AS start, seq FROM z""")
def _(t):
    return sq.sample_sites(t.tiles, sq.variant_sites(fixed(t), binned=True), lexicon(t), TILE)


@query("var_sample_pairs_replaced", sample_sql(True) + " SELECT chrom, pos, x || '_' || y AS pair FROM pr")
def _(t):
    return sq.draw_allele_pairs(sq.variant_sites(fixed(t), binned=True), replacement=True)


# intervals ---------------------------------------------------------------------------------------------

GENES = """g AS (SELECT CAST(p_partkey AS VARCHAR) AS gene, 'c' || p_partkey % 27 AS chrom, p_partkey * 40 AS start, p_partkey * 40 + p_size * 10 AS "end", CASE WHEN p_type IN ('PROMO', 'SMALL') THEN '-' ELSE '+' END AS strand FROM part),
  pm AS (SELECT gene, chrom, greatest(0, CASE WHEN strand = '+' THEN start ELSE "end" END - 500) AS promoter_start, CASE WHEN strand = '+' THEN start ELSE "end" END + 200 AS promoter_end FROM g)"""


def gene_sites(t):
    k = F.col("p_partkey")
    strand = F.when(F.col("p_type").isin("PROMO", "SMALL"), "-").otherwise("+")
    return t.part.select(k.cast("string").alias("gene"), F.concat(F.lit("c"), (k % 27).cast("string")).alias("chrom"), (k * 40).alias("start"),
                         (k * 40 + F.col("p_size") * 10).alias("end"), strand.alias("strand"))


@query("rng_promoters", "WITH " + GENES + " SELECT * FROM pm")
def _(t):
    return iv.promoters(gene_sites(t), 500, 200).select("gene", "chrom", "promoter_start", "promoter_end")


@query("rng_mean_signal", views("signal")[:-1] + ", " + GENES + """, cs AS (SELECT chrom, max("end") AS size FROM signal GROUP BY 1),
  c AS (SELECT gene, pm.chrom, promoter_start AS a, least(promoter_end, size) AS b FROM pm JOIN cs USING (chrom) WHERE promoter_start < least(promoter_end, size))
  SELECT gene, round(coalesce(sum(value * (least(b, "end") - greatest(a, start))) / sum(least(b, "end") - greatest(a, start)), 0), 6) AS signal FROM c LEFT JOIN signal s ON s.chrom = c.chrom AND s.start < b AND s."end" > a GROUP BY gene""")
def _(t):
    sizes = t.signal.groupBy("chrom").agg(F.max("end").alias("size"))
    genes = iv.promoters(gene_sites(t), 500, 200)
    return rounded(iv.mean_signal(genes, t.signal, sizes, width=1000), "signal")


@query("rng_bin_floor", views("signal") + """SELECT chrom, start, CAST(start // 64 * 64 AS BIGINT) AS start_bin, CAST("end" // 64 * 64 AS BIGINT) AS end_bin FROM signal""")
def _(t):
    return t.signal.select("chrom", "start", iv.bin_floor("start", 64).alias("start_bin"), iv.bin_floor("end", 64).alias("end_bin"))

"""Hand-worked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgene.operators import examples as ex
from tallgene.operators import filters as fl
from tallgene.operators import harmonise as hz
from tallgene.operators import intervals as iv
from tallgene.operators import metrics as mt
from tallgene.operators import normalise as nm
from tallgene.operators import ontology as on
from tallgene.operators import perturb as pt
from tallgene.operators import samples as sm
from tallgene.operators import sampling as sp
from tallgene.operators import sequence as sq
from tallgene.operators import setops as so
from tallgene.operators import stats as st
from tallgene.operators import windows as wn
from tallgene.plans import steps


def expr(spark, rows):
    return spark.createDataFrame(rows, "cell_id string, gene string, value double")


def one_cell(spark, values):
    return expr(spark, [("c", f"g{i:03d}", float(v)) for i, v in enumerate(values)])


def values(df):
    return [r["value"] for r in df.orderBy("gene").collect()]


def test_bin_percentile(spark):
    assert values(nm.bin_percentile(one_cell(spark, [1, 2, 3, 4, 10]), 4)) == [1, 2, 3, 4, 4]


def test_bin_int_cast(spark):
    assert values(nm.bin_int_cast(one_cell(spark, [0.2, 3.0, 12.7]), 10)) == [1, 3, 9]


def test_bin_value_stays_between_both_sides(spark):
    out = values(nm.bin_value(one_cell(spark, [1, 1, 1, 1, 5]), 4, seed=1))
    assert all(0 <= b <= 4 for b in out)


def test_log_without_one_clips(spark):
    out = values(nm.log_transform(one_cell(spark, [0.5, math.e]), add_one=False))
    assert out[0] == 0 and abs(out[1] - 1) < 1e-5


def test_median_missing_gene_is_an_error(spark):
    med = spark.createDataFrame([("g000", 2.0)], "gene string, median double")
    assert values(nm.median_normalize_sample(one_cell(spark, [4, 5]), med)) == [2.0]
    with pytest.raises(Exception, match="no median for gene g001"):
        nm.median_normalize(one_cell(spark, [4, 5]), med).collect()


def test_perturb_rule_grammar(spark):
    with pytest.raises(ValueError):
        nm.perturb_expression(one_cell(spark, [1]), {"g000": "MAX; drop table x"})
    out = nm.perturb_expression(one_cell(spark, [4, 5]), {"g001": "MAX*0.5"}).orderBy("gene").collect()
    assert [(r["value"], r["perturbed"]) for r in out] == [(4.0, 0), (2.5, 1)]


def test_exon_union(spark):
    ex_ = spark.createDataFrame([("a", 0, 100), ("a", 50, 120), ("a", 60, 70), ("a", 500, 600), ("b", 5, 6)], "gene string, start long, end long")
    got = {r["gene"]: r["length_kb"] for r in nm.exon_lengths(ex_).collect()}
    assert got == {"a": 0.22, "b": 0.001}


def test_noise_baseline_zero_entries(spark):
    e = expr(spark, [("c1", "a", 1.0), ("c2", "b", 0.08)])
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    base = spark.createDataFrame([("a", 0.05), ("b", 0.0)], "gene string, baseline double")
    got = {(r["cell_id"], r["gene"]): r["value"] for r in nm.replace_noise_with_baseline(e, cells, base, 0.1).collect()}
    assert got == {("c1", "a"): 1.0, ("c2", "a"): 0.05}


def test_equal_quota(spark):
    def run(sizes, total):
        df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "g string")
        return {r["g"]: r["quota"] for r in sp.equal_quotas(df, "g", F.lit(total)).collect()}

    assert run({"A": 50, "B": 150, "C": 100}, 200) == {"A": 50, "B": 75, "C": 75}
    assert run({"A": 1, "B": 5, "C": 5, "D": 5}, 8) == {"A": 1, "B": 3, "C": 2, "D": 2}


def test_auc(spark):
    df = spark.createDataFrame([("g", 0.0, 0.9), ("g", 0.0, 0.4), ("g", 5.0, 0.4), ("h", 1.0, 0.2)], "gene string, label double, s double")
    got = {r["gene"]: r["auc"] for r in mt.group_auc(df, "gene", F.col("label") == 0, "s").collect()}
    assert got == {"g": 0.75, "h": None}


@pytest.fixture(scope="module")
def dag(spark):
    ids = ["CL:root", "CL:A", "CL:B", "CL:C", "CL:shared", "CL:leaf1", "CL:leaf2", "CL:direct"]
    nodes = spark.createDataFrame([(i, i) for i in ids], "id string, name string")
    edges = spark.createDataFrame(
        [("CL:root", "CL:A"), ("CL:root", "CL:B"), ("CL:root", "CL:direct"), ("CL:A", "CL:C"), ("CL:C", "CL:leaf1"), ("CL:A", "CL:shared"),
         ("CL:B", "CL:shared"), ("CL:B", "CL:leaf2")], "parent string, child string")
    return nodes, edges


def test_ontology_leaves(spark, dag):
    nodes, edges = dag
    assert {r["id"]: r["label_id"] for r in on.leaves(nodes, edges).collect()} == {"CL:direct": 0, "CL:leaf1": 1, "CL:leaf2": 2, "CL:shared": 3}
    paths = on.closure(nodes, edges)
    ask = spark.createDataFrame([("CL:B",), ("CL:leaf1",), ("CL:none",)], "id string")
    got = {(r["ancestor"], r["leaf"]) for r in on.find_leaves(paths, on.leaves(nodes, edges), ask).collect()}
    assert got == {("CL:B", "CL:shared"), ("CL:B", "CL:leaf2"), ("CL:leaf1", "CL:leaf1")}
    kept, _ = on.prune_dead_leaves(nodes, edges, paths, spark.createDataFrame([("CL:leaf2",), ("CL:C",)], "id string"))
    assert {r["id"] for r in kept.collect()} == {"CL:root", "CL:A", "CL:B", "CL:C", "CL:leaf2"}


def test_ontology_coverage_error(spark, dag):
    with pytest.raises(Exception, match="not in the ontology: CL:zzz"):
        on.check_coverage(spark.createDataFrame([("CL:zzz",)], "id string"), dag[0]).collect()


def test_perturbation_names(spark):
    df = spark.createDataFrame([("g7+ctrl",), ("ctrl+g9",), ("P+Q",), ("ctrl",), (None,)], "perturbation string")
    assert [r[0] for r in hz.clean_plus_names(df).collect()] == ["g7", "g9", "P_Q", "Control"]


def test_gene_map_first_entry_wins(spark):
    src = spark.createDataFrame([(0, "A", "X|Y", None), (1, "X", None, "A|Z")], "row long, symbol string, alias_symbol string, prev_symbol string")
    assert {r["name"]: r["symbol"] for r in hz.build_gene_map(src).collect()} == {"A": "A", "X": "A", "Y": "A", "Z": "X"}


def test_binomial_interval(spark):
    low, high = st.proportion_ci(F.col("m"), F.col("n"), "binomial")
    row = spark.createDataFrame([(0.5, 100)], "m double, n long").select(low, high).first()
    assert np.allclose(row, (0.402, 0.598))


def test_label_ids_nan(spark):
    obs = spark.createDataFrame([("nan",), ("a",), (None,), ("zz",), ("quiet",)], "lab string")
    d = spark.createDataFrame([("lab", "a", 0), ("lab", "quiet", 1)], "label_column string, label string, label_id int")
    got = {r["lab"]: r["label_id"] for r in ex.label_ids(obs, d, "lab", silent=("quiet",)).collect()}
    assert got == {"nan": -100, "a": 0, None: -100, "zz": -100, "quiet": -100}


# sequences ---------------------------------------------------------------------------------------------

def seqs(spark, **kw):
    return spark.createDataFrame(list(kw.items()), "chrom string, seq string")


def test_remove_n_islands(spark):
    tiles = sq.to_tiles(seqs(spark, a="AAANNNNNAANNA", b="NNNNACGTNNNN", c="ACGT"), 4)
    got = {(r["chrom"], r["start"]): r["seq"] for r in sq.remove_n_islands(tiles, 4, 3, 1).collect()}
    assert got == {("a", 0): "AAAN", ("a", 7): "NAANNA", ("b", 3): "NACGTN", ("c", 0): "ACGT"}
    whole = sq.remove_n_islands(tiles, 4, 3, 5).collect()
    assert {r["chrom"]: r["seq"] for r in whole}["a"] == "AAANNNNNAANNA"


def test_islands_merge_over_tile_edges(spark):
    tiles = sq.to_tiles(seqs(spark, a="ANNNNNNNNNNA" + "C" * 5 + "NN"), 4)
    assert sorted((r["start"], r["end"]) for r in wn.islands(tiles).collect()) == [(1, 11), (17, 19)]


def test_parse_freq(spark):
    text = "one:0.75,0.25|two:0.5,0.5|three:1,.|four:0.25,0.5"
    got = spark.createDataFrame([(text,), ("S:.,1",)], "f string").select(sq.parse_freq("f").alias("p")).collect()
    assert np.allclose(got[0]["p"], (0.625, 0.3125)) and got[1]["p"] == [0.0, 1.0]


def variants(spark, rows):
    return spark.createDataFrame(rows, "chrom string, pos long, ref string, alleles array<struct<allele:string,prob:double>>")


def test_site_matrix_insertion_and_deletion(spark):
    v = variants(spark, [("a", 1, "C", [("C", 0.8), ("CAA", 0.2)]), ("a", 4, "ACG", [("ACG", 0.5), ("A", 0.5)])])
    got = {(r["pos"], r["symbol"]): (round(r["prob"], 6), r["is_variant"]) for r in sq.variant_sites(v).collect()}
    assert got == {(1, "C"): (0.8, True), (1, "CI"): (0.2, True), (4, "A"): (1.0, False), (5, "C"): (0.5, True), (5, "DEL"): (0.5, True),
                   (6, "G"): (0.5, True), (6, "DEL"): (0.5, True)}
    full = sq.site_matrix(sq.to_tiles(seqs(spark, a="GCTTACGT"), 3), v)
    assert full.groupBy("pos").count().count() == 8


def test_reverse_complement_matrix(spark):
    tiles = sq.to_tiles(seqs(spark, a="GCTA"), 3)
    v = variants(spark, [("a", 1, "C", [("C", 0.8), ("CAA", 0.2)])])
    got = {(r["pos"], r["symbol"]): round(r["prob"], 6) for r in sq.revcomp_matrix(sq.site_matrix(tiles, v), tiles).collect()}
    # the insertion after C moves to the next letter T, whose complement is A
    assert got == {(3, "C"): 1.0, (2, "G"): 1.0, (1, "A"): 0.8, (1, "AI"): 0.2, (0, "T"): 1.0}


def test_sample_pairs_frequencies(spark):
    sites = spark.range(4000).select(F.lit("a").alias("chrom"), F.col("id").alias("pos"), F.explode(F.array(
        F.struct(F.lit("A").alias("symbol"), F.lit(0.8).alias("prob")), F.struct(F.lit("AI").alias("symbol"), F.lit(0.2).alias("prob")))).alias("s"))
    sites = sites.select("chrom", "pos", "s.*", F.lit(True).alias("is_variant"))
    n = {r["pair"]: r["count"] / 4000 for r in sq.draw_allele_pairs(sites, replacement=True).groupBy("pair").count().collect()}
    assert abs(n["A_A"] - 0.64) < 0.03 and abs(n["A_AI"] - 0.32) < 0.03 and abs(n["AI_AI"] - 0.04) < 0.015
    assert {r["pair"] for r in sq.draw_allele_pairs(sites).select("pair").distinct().collect()} == {"A_AI"}


def test_extract_over_tiles(spark):
    tiles = sq.to_tiles(seqs(spark, a="ACGTACGTAC"), 4)
    spans = spark.createDataFrame([("a", 2, 9, 1), ("a", 8, 30, 2), ("a", 40, 50, 3)], "chrom string, start long, end long, id int")
    assert {r["id"]: r["seq"] for r in sq.extract(tiles, spans, 4).collect()} == {1: "GTACGTA", 2: "AC"}


def test_center_token(spark):
    df = spark.createDataFrame([(["a" * 300, "b" * 200, "c"],), (["a"],)], "t array<string>")
    assert [r[0] for r in df.select(sq.center_token("t")).collect()] == [2, -1]


def test_augment_has_seven_versions(spark):
    df = spark.createDataFrame([("AC", "GT", 1), ("AA", "CC", 0)], "seq1 string, seq2 string, contact int")
    got = [r["seq"] for r in sq.augment_pairs(df).orderBy("version").collect()]
    assert got == ["ACGT", "CAGT", "ACTG", "CATG", "GTGT", "ACAC", "GTAC"]


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    a = [(f"c{i % 2}", int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 900, 80), rng.integers(0, 200, 80)))]
    b = [(f"c{i % 2}", int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 900, 90), rng.integers(1, 120, 90)))]
    da = spark.createDataFrame(a, "chrom string, start long, end long")
    db = spark.createDataFrame(b, "chrom string, bstart long, bend long")
    got = sorted((r["chrom"], r["start"], r["end"], r["bstart"], r["bend"]) for r in iv.overlaps(da, db, 37).collect())
    want = sorted((*x, y[1], y[2]) for x in a for y in b if x[0] == y[0] and x[1] < x[2] and x[1] < y[2] and y[1] < x[2])
    assert got == want


# samples -----------------------------------------------------------------------------------------------

def ascending(spark, n=99):
    rows = [("c", f"token{i:03d}", float(i)) for i in range(1, n + 1)]
    return sm.build_samples(expr(spark, rows))


def test_rda_equal(spark):
    items = sm.rda_equal(ascending(spark), max_length=10).first()["items"]
    assert len(items) == 10 and items[0]["gene"] == "[S]" and items[1]["gene"] == "[T]"
    assert np.allclose([items[0]["value"], items[1]["value"]], math.log1p(36))


def test_rda_downsample_takes_both_branches(spark):
    rows = [(f"c{k}", f"g{i}", 30.0) for k in range(200) for i in range(5)]
    out = sm.rda_downsample(sm.build_samples(expr(spark, rows)), 100.0)
    same = out.select((F.col("items")[0]["value"] == F.col("items")[1]["value"]).alias("s")).groupBy("s").count().collect()
    n = {r["s"]: r["count"] for r in same}
    assert n[True] > 60 and n[False] > 60


def test_poisson_needs_raw_counts(spark):
    with pytest.raises(Exception, match="raw counts"):
        sm.poisson_downsample(sm.build_samples(one_cell(spark, [1.5]))).collect()


def test_poisson_mean(spark):
    df = spark.range(5000).select(sm.poisson(F.lit(3.0), F.rand(1)).alias("k"))
    assert abs(df.agg(F.avg("k")).first()[0] - 3) < 0.1


def test_pad_batchwise_ratio(spark):
    rows = []
    for k, nz in enumerate((40, 50, 60, 70, 80)):
        rows += [(f"c{k}", "b", f"g{i:03d}", i, float(i + 1) if i < nz else 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "cell_id string, batch_id string, gene string, pos int, value double")
    out = sm.pad_batchwise(df, 70, interleave=0.9)
    first = [r["value"] for r in out.where("cell_id = 'c0'").orderBy("pos").limit(10).collect()]
    last = [r["value"] for r in out.where("cell_id = 'c4'").orderBy("pos").collect()]
    assert first == [1, 2, 3, 4, 5, 6, 7, 8, 9, 0] and last[:10] == list(range(1, 11)) and 0 not in last and len(last) == 70


def test_selective_dropout_share(spark):
    rows = [(f"c{k}", f"g{i:03d}", 1.0) for k in range(300) for i in range(100)]
    w = spark.createDataFrame([(f"g{i:03d}", 4.0 - i // 25) for i in range(100)], "gene string, weight double")
    out = sm.dropout_selective(sm.build_samples(expr(spark, rows)), w, 0.3)
    assert abs(out.agg(F.avg(F.size("items"))).first()[0] / 100 - 0.7) < 0.05


def test_dropout_chunk_too_long_changes_nothing(spark):
    s = ascending(spark, 5)
    assert sm.dropout_chunk(s, 9).first()["items"] == s.first()["items"]


def test_interleave_edges(spark):
    with pytest.raises(ValueError):
        sm.interleave_positions(F.lit(0), F.lit(1), F.lit(1), F.lit(True), 1.5)


# perturbations, sets, registry ---------------------------------------------------------------------------

def test_discrimination_brute_force(spark):
    rng = np.random.default_rng(2)
    perts, genes = [f"g{i}" for i in range(9)] + ["g1_g2"], [f"g{i}" for i in range(12)]
    truth = {p: rng.random(12) for p in perts}
    pred = {p: truth[p] + rng.normal(0, 0.4, 12) for p in perts}
    rows = [(p, g, float(pred[p][i]), float(truth[p][i])) for p in perts for i, g in enumerate(genes)]
    grouped = spark.createDataFrame(rows, "perturbation string, gene string, predicted double, label double")
    got = {r["perturbation"]: r["score"] for r in pt.discrimination_scores(grouped, block=3).collect()}
    order = np.argsort(genes)
    for p in perts:
        keep = [i for i in order if genes[i] not in p.split("_")]
        d = {q: np.abs(pred[p][keep] - truth[q][keep]).sum() for q in perts}
        assert abs(got[p] - (1 - sum(v < d[p] for v in d.values()) / len(perts))) < 1e-9


def test_with_controls_rejects_other_genes(spark):
    a, b = expr(spark, [("x", "g1", 1.0)]), expr(spark, [("y", "g2", 1.0)])
    obs = spark.createDataFrame([("y", "Control")], "cell_id string, perturbation string")
    cells = spark.createDataFrame([("x", "P")], "cell_id string, perturbation string")
    with pytest.raises(Exception, match="gene sets differ"):
        so.add_controls(a, cells, b, obs)[0].collect()


def test_special_tokens_lead(spark):
    v = so.build_vocabulary(spark.createDataFrame([("B", 0), ("A", 1)], "gene string, pos long"), 2)
    got = [(r["field"], r["token"], r["local_id"]) for r in v.orderBy("global_id").collect()]
    assert got[:7] == [("genes", t, i) for i, t in enumerate([*so.SPECIAL_TOKENS, "B", "A"])] and got[7] == ("expressions", "[UNK]", 0)


def test_unknown_transform():
    with pytest.raises(ValueError):
        steps.make_transform("nope")


def test_explain_targets_error(spark):
    g = spark.createDataFrame([("a",)], "gene string")
    with pytest.raises(Exception, match="already explanatory"):
        fl.keep_explanatory_and_targets(one_cell(spark, [1]), g, g).collect()


def test_mask_rates(spark):
    rows = spark.range(20000).select(
        (F.col("id") % 200).cast("string").alias("cell_id"), F.lit(0).alias("batch_id"), F.floor(F.col("id") / 200).cast("int").alias("pos"),
        F.lit("genes").alias("field"), F.lit(9).alias("token_id"), F.lit(False).alias("special"), F.lit(1.0).alias("weight"))
    out = ex.mask_tokens(rows, 0.2, 0.8, 0.1, 4, 0, 5, 1000)
    r = out.agg(F.avg(F.col("label_id").isNotNull().cast("int")), F.avg((F.col("input_id") == 4).cast("int"))).first()
    assert abs(r[0] - 0.2) < 0.02 and abs(r[1] - 0.16) < 0.02


def test_bootstrap_mean_size(spark):
    df = spark.range(5000).withColumnRenamed("id", "cell_id")
    n = [r["count"] for r in sp.bootstrap(df, 4, keys=["cell_id"]).groupBy("run").count().collect()]
    assert len(n) == 4 and all(abs(x - 5000) < 300 for x in n)


def test_balanced_sampler(spark):
    df = spark.range(1000).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 50, "rare").otherwise("common").alias("label"))
    n = {r["label"]: r["count"] for r in sp.sample_balanced(df, "label", 4000, ["cell_id"]).groupBy("label").count().collect()}
    assert sum(n.values()) == 4000 and abs(n["rare"] - 2000) < 150


def test_pairing_is_spread_over_controls(spark):
    obs = spark.range(3000).select(F.col("id").cast("string").alias("cell_id"), F.when(F.col("id") < 300, "Control").otherwise("P").alias("perturbation"))
    per = pt.pair_control(obs).groupBy("control_id").count().agg(F.max("count"), F.sum("count")).first()
    assert per[1] == 2700 and per[0] < 40

"""Chunks cut from tiles against chunks of whole sequences."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallgene.functions.rand import hash_uniform
from tallgene.operators import sequence as sq

SEQS = {"a": 1000, "b": 1, "c": 64, "d": 63, "e": 65, "f": 0, "g": 257}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in SEQS.items()}
    return made | {"n": "N" * 200 + "ACG" + "N" * 200}


def tiles(spark, texts, width):
    rows = [(c, i, i * width, s[i * width : (i + 1) * width]) for c, s in texts.items() for i in range(-(-len(s) // width))]
    return spark.createDataFrame(rows, "chrom string, tile long, start long, seq string").repartition(5)


@pytest.mark.parametrize("width,size", [(64, 64), (64, 7), (64, 100), (10, 64), (64, 1000), (1, 3)])
def test_fixed_chunks(spark, texts, width, size):
    got = sorted(map(tuple, sq.chunk_tiles(tiles(spark, texts, width), size, reverse=True).select("chrom", "chunk", "seq").collect()))
    want = sorted((c, i, s[i * size : (i + 1) * size]) for c, s in texts.items() for i in range(-(-len(s) // size)))
    assert got == [w for w in want if set(w[2]) != {"N"}]


def test_uneven_tiles(spark, texts):
    """Tiles of different widths, cut by number and place alone."""
    s = texts["a"]
    cuts = [0, 3, 50, 51, 400, 999, 1000]
    rows = [("a", i, x, s[x:y]) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = sq.chunk_tiles(spark.createDataFrame(rows, "chrom string, tile long, start long, seq string"), 48).collect()
    assert {r["chunk"]: r["seq"] for r in got} == {i: s[i * 48 : (i + 1) * 48] for i in range(21)}


@pytest.mark.parametrize("run", [3, 1024])
def test_random_chunks(spark, texts, run, monkeypatch):
    monkeypatch.setattr(sq, "RUN", run)
    got = {(r["chrom"], r["k"]): (r["start"], r["seq"]) for r in sq.chunk_random(tiles(spark, texts, 64), 64, 2, 5, 3).collect()}
    sizes = spark.range(400).withColumnRenamed("id", "k")
    want = {}
    for c, s in texts.items():
        drawn = [r[0] for r in sizes.orderBy("k").select(F.floor(hash_uniform(42, F.lit(c), "k") * 4)).collect()]
        at = 0
        for k, d in enumerate(drawn):
            piece = s[at : at + (2 + d) * 3]
            if piece and set(piece) != {"N"}:
                want[c, k] = (at, piece)
            at += (2 + d) * 3
    assert got == want


def test_no_tiles(spark, texts):
    none = tiles(spark, texts, 64).limit(0)
    assert sq.chunk_tiles(none, 10).count() == 0 and sq.chunk_random(none, 64, 1, 2, 3).count() == 0


def test_only_border_pieces_are_exchanged(spark, texts):
    plan = sq.chunk_tiles(tiles(spark, texts, 64), 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Window" not in plan and "Join" not in plan


def test_site_matrix_exchanges_no_bases(spark, texts, monkeypatch):
    """Variants across the borders of tiles and stretches, repeated and without a chromosome, against sums over single positions."""
    monkeypatch.setattr(sq, "STRETCH", 7)
    text = texts["a"][:60]
    variants = [("a", 5, text[5:9], [(text[5:9], 0.5), ("T", 0.25), (text[5:9] + "GG", 0.25)]), ("a", 8, text[8], [(text[8], 0.5), ("T", 0.5)]),
                ("a", 8, text[8], [(text[8], 1.0)]), (None, 2, "A", [("A", 0.5), ("C", 0.5)])]
    v = spark.createDataFrame(variants, "chrom string, pos long, ref string, alleles array<struct<allele string, prob double>>")
    cut = [("a", i, s, text[s:e]) for i, (s, e) in enumerate([(0, 6), (6, 20), (20, 21), (21, 60)])] + [(None, 0, 0, "ACA")]
    out = sq.site_matrix(spark.createDataFrame(cut, "chrom string, tile long, start long, seq string"), v)
    sums = {}
    for c, pos, ref, alleles in variants:
        for allele, p in alleles:
            for o in range(len(ref)):
                s = allele[o] + "I" if len(allele) > len(ref) and o == len(ref) - 1 else allele[o] if o < len(allele) else "DEL"
                sums.setdefault((c, pos + o), {}).setdefault(s, []).append(p)
    want = {(c, at, s, round(sum(p) / sum(map(sum, by.values())), 9)) for (c, at), by in sums.items() for s, p in by.items()}
    want |= {("a", i, b, 1.0) for i, b in enumerate(text) if ("a", i) not in sums} | {(None, i, b, 1.0) for i, b in enumerate("ACA")}
    got = [(r["chrom"], r["pos"], r["symbol"], round(r["prob"], 9)) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(chrom#\d+, pos#", plan)


def test_short_ends_are_cut_without_the_others(spark, texts):
    """Only the first and the last piece of a tile go to the exchange: its side of the plan cuts no list of pieces."""
    plan = sq.chunk_tiles(tiles(spark, texts, 64), 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_alleles_are_made_once(spark):
    """No filter on the size of the alleles makes them a second time; empty and null lists have no rows."""
    rows = [("a", 1, "0.5"), ("a", 2, "."), (None, 3, "0.25")]
    v = spark.createDataFrame(rows, "chrom string, pos long, f string").select("chrom", "pos", sq.fix_reference(F.array(F.lit("A"), F.lit("C")), F.array(F.lit(0.5), F.col("f").try_cast("double"))).alias("alleles"))
    out = sq.each_allele(v, "chrom", "pos")
    assert {(r["pos"], r["allele"], r["prob"]) for r in out.collect()} == {
        (1, "A", 0.5), (1, "C", 0.5), (2, "A", 0.5), (3, "A", 0.5), (3, "C", 0.25)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("zip_with") == 1
    none = spark.createDataFrame([("a", []), ("b", None)], "chrom string, alleles array<struct<allele string, prob double>>")
    assert sq.each_allele(none, "chrom").count() == 0


def test_pairs_are_drawn_where_the_sites_are(spark):
    v = spark.createDataFrame([("a", 1020 + i, "ACG", [("ACG", 0.5), ("T", 0.5)]) for i in range(0, 60, 3)], "chrom string, pos long, ref string, alleles array<struct<allele string, prob double>>")
    out = sq.draw_allele_pairs(sq.variant_sites(v, binned=True))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sq.draw_allele_pairs(sq.variant_sites(v)).collect()))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_overlaps_exchange_rows_once(spark):
    v = spark.createDataFrame([("a", 5, "ACG"), ("a", 6, "A"), ("a", 2_000_000, "A"), ("a", 1_999_999, "AC"), ("b", 7, "A")], "chrom string, pos long, ref string")
    out = sq.overlapping_variants(v)
    assert sorted(map(tuple, out.collect())) == [("a", 6, "A"), ("a", 2_000_000, "A")]
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

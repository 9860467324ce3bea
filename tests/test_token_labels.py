"""Variant labels of tokens, splits of joined parts and sequence exports, on hand fixtures."""

import random

from pyspark.sql import functions as F

from tallgene.operators import sampling as sp
from tallgene.operators import sequence as sq
from tallgene.sources import io


def _labels(spark, chunks, sites, size):
    rows = spark.createDataFrame(chunks, "chrom string, chunk long, reverse boolean, tokens array<string>")
    return sq.token_variant_labels(rows, spark.createDataFrame(sites, "chrom string, pos long"), size)


def test_token_labels_forward_and_reverse(spark):
    chunks = [("c1", 0, False, ["AC", "GTA", "CGTAC"]), ("c1", 0, True, ["GTACG", "TAC", "GT"]), ("c1", 1, True, ["AA", "CCC"]), ("c2", 0, None, ["A", "C"]), ("c1", 2, False, []), ("c1", 3, False, None)]
    got = {(r["chrom"], r["chunk"], r["reverse"]): r["labels"] for r in _labels(spark, chunks, [("c1", 1), ("c1", 1), ("c1", 5), ("c1", 10), ("c9", 0)], 10).collect()}
    assert got == {("c1", 0, False): [1, 0, 1], ("c1", 0, True): [1, 0, 1], ("c1", 1, True): [0, 1], ("c2", 0, None): [0, 0], ("c1", 2, False): [], ("c1", 3, False): None}


def test_token_labels_against_brute_force(spark):
    rng = random.Random(4)
    size, chunks, sites = 40, [], sorted({("c", rng.randrange(2000)) for _ in range(150)})
    for chunk in range(50):
        for reverse in (False, True):
            left, tokens = size, []
            while left:
                n = min(left, rng.randint(1, 7))
                tokens.append("".join(rng.choice("ACGT") for _ in range(n)))
                left -= n
            chunks.append(("c", chunk, reverse, tokens))
    at = {p for _, p in sites}
    want = {}
    for c, chunk, reverse, tokens in chunks:
        line = [int(p in at) for p in range(chunk * size, (chunk + 1) * size)]
        line, labels = line[::-1] if reverse else line, []
        for x in tokens:
            labels.append(max(line[: len(x)]))
            line = line[len(x) :]
        want[chunk, reverse] = labels
    got = {(r["chunk"], r["reverse"]): r["labels"] for r in _labels(spark, chunks, sites, size).collect()}
    assert got == want
    assert _labels(spark, [], sites, size).count() == 0


def test_split_from_parts(spark):
    schema = "cell string, gene string"
    parts = {"train": spark.createDataFrame([("a", "g1"), ("b", "none")], schema), "dev": spark.createDataFrame([("c", "g2"), ("d", "none"), ("e", None), ("e", None)], schema)}
    got = sp.split_from_parts(parts, F.col("gene") == "none", {"dev": "test"}).collect()
    assert sorted((r["cell"], r["split"], r["split_for_test"]) for r in got if r["cell"] != "d") == [("a", "train", "train"), ("b", "train", "train"), ("c", "dev", "test"), ("e", "dev", "test"), ("e", "dev", "test")]
    assert [(r["split"], r["split_for_test"]) for r in got if r["cell"] == "d"] == [(None, None)]


def test_dna_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("ACGT", "1", "train"), ("TTTT", "2", "dev"), ("ACGT", "1", "train")], "dna string, label string, split string")
    io.write_dna_csv(rows, f"{tmp_path}/out")
    back = lambda split=None: sorted(map(tuple, io.read_dna_csv(spark, f"{tmp_path}/out", split).select("sequence", "label", "split").collect()))
    assert back() == [("ACGT", "1", "train"), ("ACGT", "1", "train"), ("TTTT", "2", "dev")] and back("dev") == [("TTTT", "2", "dev")]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "test.csv").write_text("seq,label\nGG,0\n")
    assert [tuple(r) for r in io.read_dna_csv(spark, f"{tmp_path}/plain").collect()] == [("GG", "0", "test")]


def test_token_labels_of_null_tokens(spark):
    chunks = [("c", 0, False, ["AC", None, "G"]), ("c", 0, True, ["AC", None, "G"]), ("d", 0, True, ["AC", None]), ("c", 0, False, ["ACG", None])]
    rows = spark.createDataFrame([(*c, i) for i, c in enumerate(chunks)], "chrom string, chunk long, reverse boolean, tokens array<string>, i int")
    out = sq.token_variant_labels(rows, spark.createDataFrame([("c", 1)], "chrom string, pos long"), 10)
    assert {r["i"]: r["labels"] for r in out.collect()} == {0: [1, 0, None], 1: [None, None, None], 2: [0, 0], 3: [1, 0]}
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()

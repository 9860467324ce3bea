"""Packing: the plan against best fit one by one, pieces against the tokenizers library, places without gaps."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallgene.llm import packing
from test_tokens import ODD

WORD = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Free rooms of best-fit decreasing, item by item."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64, 100])
    lengths = [min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(rng.choice([1, 5, 300, 900]))]
    lengths += [rng.randint(1, capacity)] * rng.choice([0, 150])
    plan = packing.best_fit(Counter(lengths), capacity)
    used, items = defaultdict(int), Counter()
    for r in sorted(plan.itertuples(), key=lambda r: r.offset):
        for b in range(r.bins):
            assert used[r.sequence_id + b] == r.offset
            used[r.sequence_id + b] += r.each * r.length
        items[r.length] += r.bins * r.each
    assert items == Counter(lengths)
    assert sorted(capacity - n for n in used.values()) == one_by_one(lengths, capacity)
    for _, run in plan.groupby("length"):
        ends = (run["rank"] + run["bins"] * run["each"]).tolist()
        assert run["rank"].tolist() == [0, *ends[:-1]]


def test_plan_does_not_grow_with_counts():
    rng = random.Random(5)
    shape = {n: rng.randint(1, 50) for n in range(1, 2049)}
    small, large = packing.best_fit(shape, 2048), packing.best_fit({n: c * 10**9 for n, c in shape.items()}, 2048)
    assert len(large) < 100_000 and len(small) < 100_000
    assert packing.best_fit({}, 2048).empty


def check_places(rows, capacity):
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert all(n <= capacity for n in ends.values())
    return ends


def test_pack_documents(spark):
    texts = [*ODD, *["the quick brown fox"] * 500, ODD[6]]
    docs = spark.createDataFrame([(i if i % 7 else None, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, length long, sequence_id string")
    library = Tokenizer.from_file(WORD)
    packed = packing.pack_documents(docs, WORD, capacity=512, ids=True)
    rows = packed.collect()
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), 512)):
            part = ids[a : a + 512]
            want.append((i if i % 7 else -1, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], list(r["ids"])) for r in rows]
    assert sorted(got) == sorted(want)
    rooms = check_places(rows, 512)
    assert sorted(512 - n for n in rooms.values()) == one_by_one([w[3] for w in want], 512)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert all(whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in rows)
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


def test_one_length_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    monkeypatch.setattr(packing, "RANKS", 16)
    rows = spark.range(3000).selectExpr("id AS k", "IF(id % 3 > 0, 9, 1 + id % 20) AS length", "'e' AS extra")
    packed = packing.pack(rows, ["k"], 20).collect()
    assert len(packed) == 3000 and packed[0]["extra"] == "e"
    assert sorted(20 - n for n in check_places(packed, 20).values()) == one_by_one([r["length"] for r in rows.collect()], 20)
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(rows, ["k"], 8).collect()


def test_memory_of_ids_starts_afresh(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    known, library = packing.Ids(packing.bpe.load(WORD), 0), Tokenizer.from_file(WORD)
    for text in ("one two three four", "five six", "one two <|endoftext|>"):
        ids, sizes = known.of([text, ""])
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 0, 0] and sizes.tolist()[1] == 1

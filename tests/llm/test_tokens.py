"""Token counts and encodings against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallgene.llm import bpe, lexicon, queries, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "  \n\n  x", "aaaaaaa aaaaaaaaaaaa", "abab" * 50, "héllo Σίσυφος ΣΑΣ 漢字 12³4 ½ İI ſ ﬁ", "x<|endoftext|>y <|endoftext|>", "<|startoftext|> THERE's we'LL",
    "a\x1cb\x85c d  e", "😀 👨‍👩‍👧 é é", "soft­hyphen", "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000)), "word " * 3000,
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_merging_matches_library(path):
    v, library = bpe.load(path), Tokenizer.from_file(path)
    for text in ODD:
        pieces = v.pieces(text or "")
        plain = [p for p in pieces if p not in v.special]
        symbols, counts = v.merge(plain)
        parts = iter(np.split(symbols, np.cumsum(counts)[:-1]) if plain else [])
        got = [i for p in pieces for i in ([v.special[p]] if p in v.special else next(parts).tolist())]
        assert got == library.encode(text or "", add_special_tokens=False).ids


def test_vocabulary_with_two_sources_of_a_symbol_is_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe._check(np.array([0, 3]), np.array([1, 4]), np.array([9, 9]))


def test_count_tokens(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate([*ODD, ODD[4]])], "doc_id long, text string, n_tokens long")
    library = Tokenizer.from_file(BYTE)
    rows = token_counts.count_tokens(docs, BYTE, limit=100).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        text = [*ODD, ODD[4]][r["doc_id"]] or ""
        n = len(library.encode(text).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)
    assert token_counts.count_tokens(docs.limit(0), BYTE).count() == 0


def test_memory_of_counts_starts_afresh(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    v, library = bpe.load(BYTE), Tokenizer.from_file(BYTE)
    known = dict.fromkeys(v.special, 1)
    for text in ("one two three four", "five six", "one two <|endoftext|>"):
        assert token_counts._counts(v, [text], known) == [len(library.encode(text).ids)]


def test_transducer_finds_exactly_its_words(tmp_path):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode(): [rng.randint(0, 99) for _ in range(rng.randint(1, 4))] for _ in range(400)}
    lexicon.Transducer.compile(words).save(str(tmp_path / "x.fst"))
    t = lexicon.Transducer.open(str(tmp_path / "x.fst"))
    assert len(t.edge_key) < sum(map(len, words))  # suffixes are shared
    asked = [*words, b"", b"d", b"abcabcabcabc", *("".join(rng.choice("abc") for _ in range(5)).encode() for _ in range(300))]
    for word, at in zip(asked, t.find(asked), strict=True):
        assert (at >= 0) == (word in words)
        if at >= 0:
            assert t.ids[t.id_start[at] : t.id_start[at + 1]].tolist() == words[word]
    empty = lexicon.Transducer.compile({})
    assert empty.find([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("size", [0, 50])
def test_encode_and_decode(spark, size):
    texts = [*ODD, *["the quick brown fox jumps"] * 20]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    library = Tokenizer.from_file(WORD)
    name = lexicon.ship(spark, lexicon.compile_words(bpe.load(WORD), ["the", "quick", "fox"][:size]))
    encoded = lexicon.encode(docs, WORD, name)
    decoded = {r["doc_id"]: r for r in queries.digests(lexicon.decode(encoded, WORD, keep=("doc_id", "ids")), "doc_id").collect()}
    ids = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want
        text_sha = hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
        assert decoded[i]["decoded_sha256"] == text_sha
        assert decoded[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert decoded[i]["n_tokens"] == len(want)


def test_lexicon_is_built_from_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "REPORT_AT", 2)
    docs = spark.createDataFrame([(1, "aa bb aa cc <|endoftext|> <|endoftext|>"), (2, "AA bb dd"), (3, None)], "doc_id long, text string").coalesce(1)
    assert lexicon.frequent_words(docs, WORD, 2) == ["aa", "bb"]
    name = lexicon.build_lexicon(docs.limit(0), WORD)
    assert lexicon.encode(docs, WORD, name).count() == 3


def test_decode_leaves_out_unknown_ids(spark):
    got = lexicon.decode(spark.createDataFrame([(1, [0, 10**6, -1, 1]), (2, None), (3, [])], "doc_id long, ids array<int>"), WORD).collect()
    assert {r["doc_id"]: r["decoded"] for r in got} == {1: '! "', 2: "", 3: ""}


def test_words_that_are_rare_in_every_slice_are_counted(spark):
    rows = [(i, f"often often often rare{'' if i % 2 else ' other'}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    listed = lexicon.frequent_words(docs, public_tokenizers.path("word_bpe_49k.json"), 1000)
    assert [w.strip("Ġ ") for w in listed].count("rare") == 1 and any("other" in w for w in listed)

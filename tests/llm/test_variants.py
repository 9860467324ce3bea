"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallgene.llm import variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, least, count, factor, one_in):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    n = {w: c for w, c in n.items() if c >= count}
    form, out = {}, {}
    for w in n:
        around = sorted((-n[o], o) for o in n if one_edit(w, o))
        form[w] = around[0][1] if around and -around[0][0] >= factor * n[w] else None
        out[w] = len(around)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, n[w], out[w], form[w], n[form[w]] if form[w] else None, root))
    return sorted(rows)


def check(spark, docs, **options):
    options = {"least": 4, "count": 2, "factor": 3, "one_in": 5} | options
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string").repartition(3)
    got = variants.spelling_variants(df, **options).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == plain(docs, **options)
    return got


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "aÀÿ÷"])
def test_matches_all_pairs(spark, letters, monkeypatch):
    monkeypatch.setattr(variants, "REPORT_WORDS", 20)
    rng = random.Random(letters)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 7))) for _ in range(30)]
    stems += [s[0] * 3 + s for s in stems[:5]]
    docs = [(rng.choice([None, *range(90)]), " ".join(rng.choice(stems[: rng.randint(1, 35)]) for _ in range(30))) for _ in range(120)]
    rows = check(spark, [*docs, docs[0], (7, None), (8, ""), (None, None)])
    assert any(r["form"] for r in rows)


def test_cases_and_chains(spark):
    text = "Strasse " * 300 + "STRASSE Straße Étude étude Étude étude " * 2 + "strassen " * 30 + "strassens " * 3 + "İstanbul istanbul 1abcdefg_abcdefg2 " * 2 + "x" * 5000 + " " + "x" * 5000
    rows = check(spark, [(1, text), (2, text)], least=7, factor=10, one_in=10**9)
    assert {r["word"]: r["root"] for r in rows}["strassens"] == "strasse"


def test_tables_without_words(spark):
    assert check(spark, [(1, None), (2, "a b c")]) == []
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_pair_meets_once(spark):
    words = spark.createDataFrame([("aabbcc", 5), ("abbcc", 9), ("aabbc", 2), ("aabbbcc", 1), ("zabbcc", 4)], "word string, n long")
    got = {r["word"]: r["n_near"] for r in variants.near(words).collect()}
    names = [r["word"] for r in words.collect()]
    assert got == {w: sum(one_edit(w, o) for o in names) for w in names}

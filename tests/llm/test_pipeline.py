"""The stages of the corpus pipeline, each on what the one before kept, against plain Python."""

import hashlib
import os
import re
import subprocess
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_jaccard import brute

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Rows after every stage, on the documents with a few hard rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    hard = [(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "Mail a.b@c.example.com of the day to me", "en", None, 39), (9003, "Mail a.b@c.example.com of the day to me", "en", None, 39), (None, "no id here", "en", "src2", 10)]
    docs = docs.unionByName(spark.createDataFrame(hard, docs.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_all_but_the_last_return_documents(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "bpe"]
    assert all(df.dtypes == kept[0].dtypes for df in kept[1:5])


def test_toxic_rows_go_and_clean_ones_stay(spark, kept):
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["toxic"] == 1}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["toxic"] == 0}
    left = {r["doc_id"] for r in kept[1].collect()}
    assert len(toxic & left) <= 0.3 * len(toxic) and len(clean & left) >= 0.97 * len(clean)


def test_one_document_of_each_group_stays(kept):
    rows = [(r["doc_id"], r["text"]) for r in kept[1].collect()]
    component = {i: c for i, n, c in brute(rows) if i is not None and n}
    want = {i for i, c in component.items() if i == c} | {i for i, n, _ in brute(rows) if i is None or not n}
    got = [r["doc_id"] for r in kept[2].collect()]
    assert set(got) == want and len([i for i in got if i == 9003]) == 1


def test_personal_data_is_replaced(kept):
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in (kept[2], kept[3]))
    assert before.keys() == after.keys()
    for i, r in after.items():
        text = before[i]["text"]
        found = re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<!\d)\d{16}(?!\d)|[0-9a-f]{40}", text or "")
        assert not any(f in r["text"] for f in found)
        if not re.search(r"[0-9@]|\b(?:Mr|Mrs|Ms|Herr|Frau)\b", text or ""):
            assert r["text"] == text
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_mix_takes_its_budgets(kept):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for df, sums in ((kept[3], sizes), (kept[4], taken)):
        for r in df.collect():
            sums[r["source"]] = sums.get(r["source"], 0) + words(r["text"])
    assert all(taken.get(s, 0) <= 3 * n for s, n in sizes.items())
    assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)


def test_ids_are_the_librarys(kept):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in kept[4].collect())
    got = sorted((str(r["doc_id"]), list(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in kept[5].collect())
    want = []
    for i, text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, ids, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)


def test_encoding_and_decoding_share_no_task(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    plan = corpus_pipeline.encode(spark, docs, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


HELD = """
import re, sys
import numpy as np
import pyarrow as pa
from tallgene.llm import batches

def held():
    return sum(map(int, re.findall(r"Private_Dirty:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(parts):
    for part in parts:
        small = [np.ones(4000) for _ in range(5000)]  # 160 MB in pieces that the C library keeps when they are freed
        last = small[-1]
        del small
        yield float(last.sum())

pin = []
before = held()
for x in batches.frugal(run)(iter([1, 2])):
    pin.append(bytes(2000))  # something newer stands behind the freed pieces
print(held() - before)
"""


def test_a_task_gives_back_what_it_freed():
    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("needs Linux")
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, timeout=100, env=os.environ | {"PYTHONPATH": repo}, check=True)
    assert float(out.stdout) < 40

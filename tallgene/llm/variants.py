"""Spelling variants by a permuterm index: words one edit apart meet in sorted rotations."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgene.llm.batches import slices
from tallgene.llm.graph import kept

LETTERS = "A-Za-zÀ-ÿ"
#: Marks a word's end in its rotations; no letter.
END = "$"
#: Distinct words of a task after which it reports their counts.
REPORT_WORDS = 200_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def worn(doc_id, run: str, one_in: int) -> str:
    """The run without one code point in one of ``one_in`` documents, told by a checksum of document and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame, *, least: int = 7, one_in: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters of all whole texts, A-Z lower-cased, worn, of ``least`` code points and more.

    Null and empty texts have none; a null key counts as the empty text. Tasks count before the shuffle.
    """
    find = re.compile(f"[{LETTERS}]{{{least},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, batch.column("bytes").to_numpy(zero_copy_only=False), 4_000_000):
                for doc_id, x in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(find(x.encode().translate(_LOWER).decode())).items():
                        if zlib.crc32(word.encode(), prefix) % one_in == 0:
                            word = worn(doc_id, word, one_in)
                            if len(word) < least:
                                continue
                        seen[word] += n
                if len(seen) > REPORT_WORDS:
                    yield report()
                    seen.clear()
        yield report()

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, cut, first, word, n): rotations of every word and its END, whole (``cut`` null) and as prefix that skips their last code point.

    Words that differ in one code point share the prefix behind it; a word without it is that prefix as a whole rotation. ``first``
    is false where the skipped code point repeats the one before: deleting either gives the same word, and the first one tells it.
    """
    each = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("j"))
    whole = F.concat(F.substr("word", F.col("j") + 1), F.lit(END), F.substr("word", F.lit(1), F.col("j")))
    last = F.when(F.col("j") > 0, F.substr("word", F.col("j"), F.lit(1)))
    before = F.when(F.col("j") > 1, F.substr("word", F.col("j") - 1, F.lit(1))).otherwise("")
    entry = lambda key, cut, first: F.struct(key.alias("key"), cut.alias("cut"), first.alias("first"))
    prefix = F.substr(whole, F.lit(1), F.length(whole) - 1)
    both = F.array(entry(whole, F.lit(None).cast("string"), F.lit(True)), entry(prefix, last, last != before))
    return each.select("word", "n", F.explode(both).alias("e")).where("e.cut IS NOT NULL OR e.first").select("e.key", "e.cut", "e.first", "word", "n")


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of words that have a word one edit apart: how many, and the one of largest n, ties to the smaller.

    The rotations are sorted over the cluster and scanned. A group of one key has one word for each code point skipped and at
    most one whole rotation, so it is bounded by the letters there are; each member reports once, no pairs are written. A pair meets in
    exactly one group.
    """
    schema = "word string, n_near long, best_n long, best string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> None:
            if len(group) < 2:
                return
            skipped = sorted((-n, w, first) for cut, first, w, n in group if cut is not None)
            whole = [(-n, w) for cut, _, w, n in group if cut is None]
            told = [(n, w) for n, w, first in skipped if first]
            for n, w, first in skipped:
                others = [*((m, o) for m, o, _ in skipped[:2] if o != w), *(whole if first else [])]
                if others:
                    out.append((w, len(skipped) - 1 + (len(whole) if first else 0), *min(others)))
            if whole and told:
                out.append((whole[0][1], len(told), *told[0]))

        def report() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            w, c, n, b = columns
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(c, pa.int64()), pa.array([-x for x in n], pa.int64()), pa.array(b, pa.string())], names=["word", "n_near", "best_n", "best"])

        out: list[tuple] = []
        group: list[tuple] = []
        key = None
        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "cut", "first", "word", "n")), strict=True):
                if k != key:
                    close()
                    key, group = k, []
                group.append(tuple(row))
            yield report()
            out.clear()
        close()
        yield report()

    found = rotations(words).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(scan, schema)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(links: DataFrame, hops: int) -> DataFrame:
    """(word, root) for links (word, form) without circles: the last form, ``hops`` steps away at most; each round doubles the steps taken."""
    at = kept(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(1, hops)))):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = kept(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def spelling_variants(docs: DataFrame, *, least: int = 7, count: int = 2, factor: int = 10, one_in: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that occurs ``count`` times in all texts together.

    Words are near if one inserted, deleted or replaced code point makes one the other. The form of a word is its near word of largest
    n, ties to the smaller in code-point order, if that n is ``factor`` times its own at least; the root is the last of the forms of
    forms, the word itself without any. Each form has ``factor`` times the count, so chains are shorter than the logarithm of the largest.
    Repeated rows of documents count again; tables without words give an empty result.
    """
    words = kept(count_words(docs, least=least, one_in=one_in, key=key, text=text).where(F.col("n") >= count), "words")
    beside = near(words)
    formed = F.col("best_n") >= factor * F.col("n")
    joined = kept(words.join(beside, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"),
    ), "near")
    most = words.agg(F.max("n")).first()[0] or 1
    hops = 0
    while most >= factor:
        most, hops = most // factor, hops + 1
    root = roots(joined.where("form IS NOT NULL"), hops)
    return joined.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))

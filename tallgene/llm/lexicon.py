"""Encoding and decoding with a minimal acyclic transducer of frequent words.

The transducer maps a word's bytes to its place in a table of id sequences. It is built once from the corpus's most
frequent words, shipped as a file, memory-mapped by every worker, and walked for all words of a slice at once. Words it
does not hold are merged exactly, so its content decides speed and never a result.
"""

from __future__ import annotations

import os
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgene.llm import bpe
from tallgene.llm.batches import frugal, slices, text_slices, texts_of
from tallgene.llm.graph import most_frequent

#: Words of the transducer and bytes of the longest: its file stays within a few MB at any corpus size.
LEXICON_WORDS, WORD_BYTES = 50_000, 48
#: A task reports every word it has met so often in 16 MB of text: at 1 all words, so that the sums cover all texts.
REPORT_AT, REPORT_BYTES = 1, 16_000_000


class Transducer:
    """Arrays of a minimal acyclic automaton whose edges carry how many smaller words they skip; paths add up to a word's number."""

    PARTS = ("edge_key", "edge_to", "edge_skip", "final", "id_start", "ids")

    def __init__(self, **parts: np.ndarray):
        for name in self.PARTS:
            setattr(self, name, parts[name])

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Transducer:
        """Words in byte order are added one by one; the branch a new word leaves is replaced by an equal registered one."""
        nodes: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # parent, byte, child: the branch that is still open

        def close(depth: int) -> None:
            while len(path) > depth:
                parent, byte, child = path.pop()
                form = (final[child], *nodes[child].items())
                nodes[parent][byte] = register.setdefault(form, child)

        previous = b""
        ordered = sorted(w for w in words if w)
        for word in ordered:
            same = 0
            for a, b in zip(word, previous, strict=False):
                if a != b:
                    break
                same += 1
            close(same)
            at = path[-1][2] if path else 0
            for byte in word[same:]:
                nodes.append({})
                final.append(False)
                nodes[at][byte] = len(nodes) - 1
                path.append((at, byte, len(nodes) - 1))
                at = len(nodes) - 1
            final[at] = True
            previous = word
        close(0)
        below: dict[int, int] = {}

        def count(node: int) -> int:
            if node not in below:
                below[node] = final[node] + sum(map(count, nodes[node].values()))
            return below[node]

        count(0)
        place = {node: i for i, node in enumerate(sorted(below))}
        edges = []
        for node in below:
            skip = int(final[node])
            for byte, to in sorted(nodes[node].items()):
                edges.append((place[node] << 8 | byte, place[to], skip))
                skip += below[to]
        key, to, skip = np.array(sorted(edges), np.int64).reshape(-1, 3).T
        sizes = [len(words[w]) for w in ordered]
        return cls(
            edge_key=key, edge_to=to, edge_skip=skip, final=np.array([final[n] for n in sorted(below)], np.int64),
            id_start=np.r_[0, np.cumsum(sizes, dtype=np.int64)], ids=np.array([i for w in ordered for i in words[w]], np.int64),
        )

    def save(self, path: str) -> None:
        """One file: the lengths of the parts, then the parts."""
        parts = [getattr(self, name) for name in self.PARTS]
        np.concatenate([np.array([len(p) for p in parts], np.int64), *parts]).tofile(path)

    @classmethod
    def open(cls, path: str) -> Transducer:
        whole = np.memmap(path, np.int64, "r")
        ends = np.cumsum([len(cls.PARTS), *whole[: len(cls.PARTS)]])
        return cls(**{name: whole[a:b] for name, a, b in zip(cls.PARTS, ends[:-1], ends[1:], strict=True)})

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if it is not in the lexicon. All words take a step together; lost ones drop out."""
        found = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((sizes > 0) & (sizes <= WORD_BYTES))
        if not len(self.edge_key) or not len(live):
            return found
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(sizes) - sizes
        node, number = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for step in range(int(sizes[live].max())):
            key = node << 8 | raw[start[live] + step]
            at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            on = self.edge_key[at] == key
            live, at = live[on], at[on]
            node, number = self.edge_to[at], number[on] + self.edge_skip[at]
            ended = sizes[live] == step + 1
            word = ended & (self.final[node] == 1)
            found[live[word]] = number[word]
            live, node, number = live[~ended], node[~ended], number[~ended]
            if not len(live):
                break
        return found


def ragged_take(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Flat places start[i] .. start[i] + size[i] - 1, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def frequent_words(docs: DataFrame, vocabulary: str, words: int, text: str = "text") -> list[str]:
    """The corpus's most frequent pre-tokens, counted over all texts; ties by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report() -> pa.RecordBatch:
            often = [(w, n) for w, n in seen.items() if n >= REPORT_AT and len(w.encode("utf-8", "surrogateescape")) <= WORD_BYTES]
            often = [(w, n) for w, n in often if w.isprintable() and w not in bpe.load(vocabulary).special]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["word", "n"])

        seen: Counter[str] = Counter()
        size = 0
        for batch in batches:
            for part in text_slices(batch):
                for x in texts_of(part):
                    seen.update(bpe.load(vocabulary).pieces(x))
                    size += len(x)
                if size > REPORT_BYTES:
                    yield report()
                    seen.clear()
                    size = 0
        yield report()

    rows = docs.select(F.col(text).alias("text")).mapInArrow(frugal(run), "word string, n long")
    return [r["word"] for r in most_frequent(rows.groupBy("word").agg(F.sum("n").alias("n")), words).collect()]


def build_lexicon(docs: DataFrame, vocabulary: str, *, words: int = LEXICON_WORDS, text: str = "text") -> str:
    """Compile the transducer and ship it with the job; returns the name under which workers find it.

    The driver holds ``words`` words at most. Executors that join later fetch the file too.
    """
    v = bpe.load(vocabulary)
    return ship(docs.sparkSession, compile_words(v, frequent_words(docs, vocabulary, words, text)))


def compile_words(v: bpe.ByteBpe, words: Iterable[str]) -> Transducer:
    listed = list(words)
    symbols, counts = v.merge(listed)
    parts = np.split(symbols, np.cumsum(counts)[:-1]) if listed else []
    return Transducer.compile({w.encode(): p.tolist() for w, p in zip(listed, parts, strict=True)})


def ship(spark: SparkSession, transducer: Transducer) -> str:
    fd, path = tempfile.mkstemp(prefix="lexicon-", suffix=".fst")
    os.close(fd)
    transducer.save(path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


@lru_cache(maxsize=2)
def _opened(name: str) -> Transducer:
    return Transducer.open(SparkFiles.get(name))


def encode_slice(v: bpe.ByteBpe, lexicon: Transducer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and how many each text has."""
    number: dict[str, int] = {}
    put = number.setdefault
    places, lengths = [], []
    for x in texts:
        places += [put(w, len(number)) for w in v.pieces(x)]
        lengths.append(len(places))
    words = list(number)
    at = lexicon.find([w.encode("utf-8", "surrogateescape") for w in words])
    special = {i: v.special[w] for i, w in enumerate(words) if w in v.special} if any(s in number for s in v.special) else {}
    missing = [i for i in np.flatnonzero(at < 0).tolist() if i not in special]
    merged, counts = v.merge([words[i] for i in missing])
    pool = np.concatenate([lexicon.ids, merged, np.fromiter(special.values(), np.int64, len(special))])
    start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    known = at >= 0
    start[known], size[known] = lexicon.id_start[at[known]], np.diff(lexicon.id_start)[at[known]]
    if missing:
        start[missing], size[missing] = len(lexicon.ids) + np.cumsum(counts) - counts, counts
    if special:
        start[list(special)], size[list(special)] = len(pool) - len(special) + np.arange(len(special)), 1
    of = np.array(places, np.int64)
    ids = pool[ragged_take(start[of], size[of])]
    ends = np.r_[0, np.cumsum(size[of])][np.array(lengths, np.int64)]
    return ids, np.diff(np.r_[0, ends])


def encode(docs: DataFrame, vocabulary: str, lexicon: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with ``ids`` (array of int) of each whole text, as the vocabulary's own library encodes it without added tokens.

    A special token inside a text gets its id. Null and empty texts get an empty array; repeated rows stay rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.load(vocabulary)
        for batch in batches:
            for part in text_slices(batch, "__text"):
                ids, sizes = encode_slice(v, _opened(lexicon), texts_of(part, "__text"))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "ids"])

    slim = docs.select(*keep, F.col(text).alias("__text"))
    return slim.mapInArrow(frugal(run), T.StructType([*slim.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, vocabulary: str, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``decoded``: the tokens of ``ids`` joined by one space, special ones included, as a file without decoder asks for.

    Null or empty ids give the empty text; ids outside the vocabulary are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = bpe.load(vocabulary).tokens
        table = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        for batch in batches:
            for part in slices(batch, pc.fill_null(pc.list_value_length(batch.column("__ids")), 0).to_numpy(zero_copy_only=False), 1_000_000):
                flat, sizes = _kept_ids(part.column("__ids"), table)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), table.take(pa.array(flat)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pc.binary_join(lists, " ")], names=[*part.schema.names[:-1], "decoded"])

    slim = encoded.select(*keep, F.col("ids").alias("__ids"))
    return slim.mapInArrow(frugal(run), T.StructType([*slim.schema.fields[:-1], T.StructField("decoded", T.StringType())]))


def _kept_ids(lists: pa.ListArray, table: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    inside = (flat >= 0) & (flat < len(table))
    inside[inside] = pc.is_valid(table).to_numpy(zero_copy_only=False)[flat[inside]]
    rows = np.repeat(np.arange(len(sizes)), sizes)[inside]
    return flat[inside], np.bincount(rows, minlength=len(sizes))

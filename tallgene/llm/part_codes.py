"""Vectors as codes of parts: codebooks refined over anchors-hierarchy trees that are built once for each block of rows."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgene.functions.ranks import meet
from tallgene.llm.anchors import EXACT, AnchorTree
from tallgene.llm.graph import kept

#: Rows of a block: its trees and points are a few MB.
BLOCK = 2048
#: Components of 2 ** 62 and more have no 64-bit floor.
LARGEST = float(1 << 62)


def integer_rows(vectors: DataFrame, scale: int, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, x) with x the floors of scale * component; rows of vectors that are null or hold null or non-finite components go."""
    x = F.transform(vector, lambda e: e.cast("double") * scale)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), x.alias("x")).where("x IS NOT NULL")
    rows = rows.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= LARGEST)))
    return rows.withColumn("x", F.transform("x", lambda e: F.floor(e)))


def _blocks(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """One row for up to BLOCK rows of a task: lists of id and label, and the trees of all parts or, for large numbers, the points."""
    schema = T.StructType([*[T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in ("id", "label")], T.StructField("trees", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width)
                out = io.BytesIO()
                if np.abs(x).max(initial=0) <= EXACT and width <= 1024:
                    np.savez(out, **{k: v for p in range(parts) for k, v in AnchorTree.build(np.ascontiguousarray(x[:, p], np.float64)).arrays(f"{p}_").items()})
                else:
                    np.savez(out, x=x)
                ends = pa.array([0, n], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, part.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([out.getvalue()], pa.binary())], names=schema.names)

    return rows.select("id", "label", "x").mapInArrow(run, schema)


def _plain(x: np.ndarray, entries: list) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance in integers of any size; for blocks whose numbers float64 does not hold."""
    wide = x.astype(object)
    far = np.array([((wide - np.array([int(c) for c in e], object)) ** 2).sum(1) for e in entries], object)
    best = np.array([min(range(len(entries)), key=lambda k: (far[k, i], k)) for i in range(len(x))], np.int64)
    return best, far[best, np.arange(len(x))]


def _small(book: list) -> bool:
    return all(abs(c) <= EXACT for e in book for c in e)


def _sums(blocks: DataFrame, books: list, width: int) -> DataFrame:
    """(part, entry, place, total, n) added up over all blocks of a task."""
    schema = "part int, entry int, place int, total decimal(38,0), n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), max(map(len, books)), width), object)
        n = np.zeros(total.shape[:2], np.int64)
        for batch in batches:
            for raw in batch.column("trees").to_pylist():
                arrays = np.load(io.BytesIO(raw))
                for p, book in enumerate(books):
                    if "x" in arrays or not _small(book):
                        x = _points(arrays, p)
                        best, _ = _plain(x, book)
                        np.add.at(total[p], best, x.astype(object))
                        np.add.at(n[p], best, 1)
                        continue
                    mine = np.zeros((len(book), width))

                    def settle(entry, low, high, sums, p=p, mine=mine):
                        np.add.at(mine, entry, sums)
                        np.add.at(n[p], entry, high - low)

                    AnchorTree.of(arrays, f"{p}_").owners(np.array(book), settle)
                    total[p, : len(book)] += mine.astype(np.int64).astype(object)
        p, e, i = np.indices(total.shape).reshape(3, -1)
        sums = pa.array([Decimal(int(t)) for t in total.ravel()], pa.decimal128(38, 0))
        made = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(i.astype(np.int32)), sums, pa.array(np.repeat(n.ravel(), width))]
        yield pa.RecordBatch.from_arrays(made, names=["part", "entry", "place", "total", "n"])

    return blocks.mapInArrow(run, schema).where("n > 0").groupBy("part", "entry", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))


def _points(arrays, p: int) -> np.ndarray:
    """Integer points of a part in the rows' order."""
    if "x" in arrays:
        return arrays["x"][:, p]
    tree = AnchorTree.of(arrays, f"{p}_")
    x = np.empty(tree.points.shape, np.int64)
    x[tree.order] = tree.points
    return x


def refined(blocks: DataFrame, books: list, width: int, rounds: int) -> list:
    """Codebooks after ``rounds`` of assigning all parts and taking floors of means. The driver holds the codebooks and as many sums."""
    for _ in range(rounds):
        after = [[list(e) for e in book] for book in books]
        for r in _sums(blocks, books, width).collect():
            after[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
        books = after
    return books


def _coded(blocks: DataFrame, books: list, label_type: T.DataType) -> DataFrame:
    """(id, label, code, error) of every row of every block. An error beyond 64 bits is null."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                arrays = np.load(io.BytesIO(row.column("trees")[0].as_py()))
                codes, error = [], 0
                for p, book in enumerate(books):
                    x = _points(arrays, p)
                    if "x" in arrays or not _small(book):
                        best, far = _plain(x, book)
                    else:
                        tree = AnchorTree.of(arrays, f"{p}_")
                        best = np.empty(len(x), np.int64)

                        def settle(entry, low, high, _, tree=tree, best=best):
                            for e, a, b in zip(entry.tolist(), low.tolist(), high.tolist(), strict=True):
                                best[tree.order[a:b]] = e

                        tree.owners(np.array(book), settle)
                        far = ((x - np.array(book, np.int64)[best]) ** 2).sum(1).astype(object)
                    codes.append(best.astype(np.uint8))
                    error = error + far
                made = [pa.array([bytes(c).hex() for c in np.stack(codes, 1)], pa.string()), pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays([row.column("id").flatten(), row.column("label").flatten(), *made], names=schema.names)

    return blocks.mapInArrow(run, schema)


def compress(
    vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector, after ``rounds`` of exact refinement over all rows.

    Components become floors of ``scale`` times their value; a codebook starts as its part of the ``entries`` (256 at most) rows of
    smallest vec_id, nulls last, ties by the vector. Rows whose vector is null or holds null or non-finite components, or one whose floor needs
    more than 62 bits, are dropped. Vectors must have one length, a multiple of ``parts``: the most frequent such length (the
    smaller of two) is coded, rows of others keep null codes and errors. Repeated rows stay rows; equal labels, nulls
    together, share the sum of their errors; sums beyond 64 bits are null. An empty table gives an empty result.

    Trees are built once, from rows as they lie, and written; every round reads them and adds up sums of balls and counts, of
    which one number for each place of the codebooks reaches the driver.
    """
    rows = kept(integer_rows(vectors, scale, key, vector, label), "integers")
    sized = rows.groupBy(F.size("x").alias("w")).count().where(f"w > 0 AND w % {parts} = 0").orderBy(F.desc("count"), "w").limit(1).collect()
    label_type = rows.schema["label"].dataType
    size = sized[0]["w"] if sized else 0
    alike = rows.where(F.size("x") == size)
    width = size // parts
    smallest = [r["x"] for r in alike.orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()] if sized else []
    books = [[list(x[p * width : (p + 1) * width]) for x in smallest] for p in range(parts)]
    others = rows.where(F.size("x") != size).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = others
    if sized:
        blocks = kept(_blocks(alike, width, parts), "blocks")
        books = refined(blocks, books, width, rounds)
        coded = kept(_coded(blocks, books, label_type).unionByName(others), "coded")
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    of_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return meet(coded, of_label, ["label"]).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))

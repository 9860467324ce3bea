"""Exact inner-product top-k by a dual-tree walk: cover trees over blocks of queries and of data, pruned by covering radii."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallgene.llm.graph import kept

LEAF = 128


@dataclass
class Node:
    """Points rows[start:stop] of a tree's order; all lie within ``radius`` of ``center``."""

    center: np.ndarray
    radius: float
    start: int
    stop: int
    children: list[Node]


class CoverTree:
    """Nodes halve the covering radius from level to level; a node's points go to the nearest of its net points.

    A net point lies farther than half the radius from all others of its node, so siblings are apart and children are close.
    """

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.vectors = vectors
        self.root = self._build(np.arange(len(vectors)), 0) if len(vectors) else None

    def _build(self, rows: np.ndarray, start: int) -> Node:
        points = self.vectors[rows]
        center = points[np.argmin(((points - points.mean(0)) ** 2).sum(1))]
        apart = np.sqrt(((points - center) ** 2).sum(1))
        # rounding up keeps the covering radius a bound
        node = Node(center, float(apart.max()) * (1 + 1e-9), start, start + len(rows), [])
        if len(rows) <= LEAF or node.radius == 0:
            self.order[start : start + len(rows)] = rows
            return node
        net, owner, nearest = [int(apart.argmax())], np.zeros(len(rows), np.int64), None
        nearest = np.sqrt(((points - points[net[0]]) ** 2).sum(1))
        most = max(2, 2 * len(rows) // LEAF)  # children of about a leaf's size at least
        while nearest.max() > node.radius / 2 and len(net) < most:
            far = int(nearest.argmax())
            d = np.sqrt(((points - points[far]) ** 2).sum(1))
            owner[d < nearest], nearest = len(net), np.minimum(d, nearest)
            net.append(far)
        parts = [rows[owner == i] for i in range(len(net))]
        if len(net) == 1:
            half = np.argsort(nearest, kind="stable")
            parts = [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
        at = start
        for part in parts:
            if len(part):
                node.children.append(self._build(part, at))
                at += len(part)
        return node


def _merge(best: tuple[np.ndarray, np.ndarray], rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Put candidates (queries x candidates) into the best k of ``rows``: higher score first, then smaller id."""
    s = np.concatenate([best[0][rows], scores], 1)
    i = np.concatenate([best[1][rows], np.broadcast_to(ids, scores.shape)], 1)
    if s.dtype == object:
        order = np.array([sorted(range(s.shape[1]), key=lambda c: (-a[c], b[c]))[:k] for a, b in zip(s, i, strict=True)])
    else:
        order = np.lexsort((i, -s), axis=1)[:, :k]
    best[0][rows], best[1][rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


#: Above this bound of a sum of products float64 may round it; beyond 63 bits int64 overflows.
ROUNDS, OVERFLOWS = 2.0**53, 2.0**62


def exact_products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held in float64: in float64 where that is exact, else in int64, else in integers of any size
    that stop at the ends of 64 bits."""
    bound = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1]
    if bound < ROUNDS:
        return queries @ data.T
    if bound < OVERFLOWS:
        return (queries.astype(np.int64) @ data.astype(np.int64).T).astype(object)
    whole, most = np.frompyfunc(int, 1, 1), np.iinfo(np.int64).max
    return np.frompyfunc(lambda s: max(-most, min(most, s)), 1, 1)(whole(queries) @ whole(data).T)


def dual_search(queries: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best scores and ids (queries x k); -inf where nothing reaches the query's floor. A query never meets its own id.

    Node pairs are taken best bound first. A pair is dropped when the bound of the two nodes, centers' product plus what the
    radii can add, is below the worst of the k-th scores and floors in the query node; equal bounds are kept for ties. Bounds are float64 with
    a margin for their rounding, scores are exact: of a type that holds Python's integers if float64 does not hold them.
    """
    rounded = len(queries) and len(data) and np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1] >= ROUNDS
    best = (np.full((len(queries), k), -np.inf, object if rounded else float), np.full((len(queries), k), np.iinfo(np.int64).max))
    if not len(queries) or not len(data):
        return best
    qt, dt = CoverTree(queries), CoverTree(data)

    def worst(node: Node) -> float:
        own = qt.order[node.start : node.stop]
        return float(np.maximum(best[0][own, -1].astype(float), floors[own]).min())

    def bounds(q: Node, nodes: list[Node]) -> np.ndarray:
        centers, radii = np.stack([n.center for n in nodes]), np.array([n.radius for n in nodes])
        lengths, length = np.sqrt((centers**2).sum(1)), np.sqrt((q.center**2).sum())
        top = centers @ q.center + q.radius * lengths + radii * length + q.radius * radii
        return top + (lengths + radii) * (length + q.radius) * 1e-9

    heap: list[tuple[float, int, Node, Node]] = [(-bounds(qt.root, [dt.root])[0], 0, qt.root, dt.root)]
    pushed = 1
    while heap:
        bound, _, q, d = heapq.heappop(heap)
        if -bound < worst(q):
            continue
        if not q.children and not d.children:
            rows, found = qt.order[q.start : q.stop], dt.order[d.start : d.stop]
            scores = exact_products(queries[rows], data[found])
            if rounded:
                scores = scores.astype(object)
            scores[(q_ids[rows][:, None] == ids[found][None]) | (scores < floors[rows][:, None]).astype(bool)] = -np.inf
            better = ((scores >= best[0][rows, -1][:, None]) & (scores > -np.inf)).astype(bool)
            some, any_of = better.any(1), better.any(0)
            if some.any():
                _merge(best, rows[some], scores[np.ix_(some, any_of)], ids[found][any_of], k)
            continue
        if d.children and (not q.children or d.radius >= q.radius):
            pairs = [(q, c) for c in d.children]
            tops = bounds(q, d.children)
        else:
            pairs = [(c, d) for c in q.children]
            tops = np.array([bounds(c, [d])[0] for c in q.children])
        for (a, b), top in zip(pairs, tops, strict=True):
            if top >= worst(a):
                heapq.heappush(heap, (-float(top), pushed, a, b))
                pushed += 1
    return best


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * x) of every component; vectors that are null or hold null or non-finite components are left out."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & ~bad).select(F.col(key).cast("long").alias("id"), scaled.alias("v"))


def exact_top_k(vectors: DataFrame, is_query, *, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query row with all other rows.

    ``is_query`` is a condition on the column ``id``. Vectors of another length than a query's never meet it; ties go to the
    smaller id; scores are exact and stop at the ends of 64 bits; rows that repeat an id stay rows, and those of a query's id share one list; an empty table gives an empty result. Blocks of data meet
    blocks of queries by an equi join of block numbers, each pair one bounded dual-tree walk. Floors, each query's k-th score in one
    block, go along first, so that other blocks prune from the start and return few rows.
    """
    whole = kept(whole_numbers(vectors, key, vector, scale).withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries = whole.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    hashed = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    data = whole.withColumn("db", hashed(blocks)).drop("row")
    numbered = whole.where(is_query).withColumn("qb", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(q_blocks)).cast("int"))
    queries = numbered.select(F.col("id").alias("q"), F.col("v").alias("qv"), F.col("dim").alias("q_dim"), F.col("qb").alias("q_block"))

    def meet(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            q_ids, ids = left["q"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
            floors = np.nextafter(left["floor"].to_numpy(float), -np.inf)  # a long may have been rounded up
            scores, found = dual_search(np.stack(left["qv"].to_list()), q_ids, floors, np.stack(right["v"].to_list()), ids, k)
            row, col = np.nonzero((scores > -np.inf).astype(bool))
            out = [pd.DataFrame({"query_id": q_ids[row], "vec_id": found[row, col], "score": scores[row, col].astype(np.int64)})]
        return out[0] if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    def search(asked: DataFrame, first: int, last: int) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(first), F.lit(last - 1)))
        left = asked.withColumn("d_block", numbers)
        right = data.where(F.col("db").between(first, last - 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        return left.groupBy("d_block", "q_block", "q_dim").cogroup(right.groupBy("db", "qb", "dim")).applyInPandas(meet, "query_id long, vec_id long, score long")

    ranked = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked = queries.withColumn("floor", F.lit(float("-inf")))
    if blocks > 1:
        kth = search(asked, 0, 1).withColumn("n", F.row_number().over(ranked)).where(F.col("n") == k)
        floors = kept(kth.select(F.col("query_id").alias("q"), F.col("score").cast("double").alias("floor")), "floors")
        asked = queries.join(floors, "q", "left").fillna(float("-inf"), ["floor"])
    rank = F.row_number().over(ranked)
    return search(asked, 0, blocks).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

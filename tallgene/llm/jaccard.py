"""Exact Jaccard join of documents on word shingles, as a metric-space join with pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallgene.llm.batches import frugal, text_slices
from tallgene.llm.graph import KeyFilter, components, kept, most_frequent
from tallgene.llm.hashing import MIX, Words, joined, mix, runs

SHINGLE, NEAR = 5, 0.25
#: Classes of the shingle universe for small sets; their counts bound distances from below. Larger sets have one for about four shingles.
CLASSES = 64
#: A shingle is put last in the order of prefixes if it is among the HOT most frequent of those seen LOCAL times in a slice of SLICE shingles.
HOT, LOCAL, SLICE = 1 << 18, 4, 1 << 20
#: Members of a region that one task compares by sketches and shingles of a cell that one task joins; larger cells are joined pivot by
#: pivot over all tasks, so many pivots a round and so many parts a cell.
REGION, CELL, PIVOTS, SALTS = 4096, 2_000_000, 64, 32
#: A larger region is compared in blocks of so many members, dealt by bands of sizes: sizes of linked sets differ by a third at most, less than a band.
BLOCK, BAND = 2048, 1.34
#: Members that meet one by one, and bytes of text that are shingled together.
LEAF, TEXT = 32, 1_000_000
# ASCII white space ends words, A-Z are lower-cased; byte 255, which UTF-8 never has, stands for byte 0.
WORD_BYTES = np.arange(256, dtype=np.uint8)
WORD_BYTES[0] = 255
WORD_BYTES[[9, 10, 11, 12, 13, 32]] = 0
WORD_BYTES[ord("A") : ord("Z") + 1] += 32


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text: of five words, or all words if they are fewer; none without words."""
    raw, offsets = joined([(x or "").encode("utf-8", "surrogatepass") for x in texts], b" ")
    w = Words(raw, WORD_BYTES)
    h, first = w.hashes(), w.firsts(offsets)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        out.append(np.unique(runs(h[a:b], min(SHINGLE, b - a))) if b > a else np.zeros(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    """So many first shingles, in any common order, of two linked sets meet."""
    return n - -(-3 * n // 4) + 1 if n else 0


def classes(n: int) -> int:
    """Number of classes, a power of two, in the sketch of a set of n shingles."""
    return min(1 << 14, max(CLASSES, 1 << max(0, (n - 1) // 4).bit_length()))


def linked(common, a, b):
    return 100 * common >= 75 * (a + b - common)


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("doc_id")


def hot_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles, at most HOT, sorted. They only set the order of prefixes, so any list gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(parts: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["s", "n"])

        parts, size = [], 0
        for batch in batches:
            for part in text_slices(batch, limit=TEXT):
                sets = shingle_sets(part.column("text").to_pylist())
                parts += sets
                size += sum(map(len, sets))
                if size >= SLICE:
                    yield report(parts)
                    parts, size = [], 0
        yield report(parts)

    rows = docs.select("text").mapInArrow(frugal(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = most_frequent(rows.where(F.col("n") >= 2 * LOCAL), HOT).select("s").toPandas()["s"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def signatures(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc_id, n, k1, k2, sketch, prefix): set size, 128-bit key of the set, counts by class and the prefix, hot shingles last."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for batch in batches:
            for part in text_slices(batch, limit=TEXT):
                rows = []
                for doc, s in zip(_ids(part).to_pylist(), shingle_sets(part.column("text").to_pylist()), strict=True):
                    at = np.minimum(np.searchsorted(hot, s), max(0, len(hot) - 1))
                    late = hot[at] == s if len(hot) else np.zeros(len(s), bool)
                    prefix = np.concatenate([s[~late], s[late]])[: prefix_size(len(s))]
                    m = classes(len(s))
                    sketch = np.minimum(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8)
                    keys = np.array([s.sum(dtype=np.uint64), mix(s ^ MIX[0]).sum(dtype=np.uint64)]).view(np.int64)
                    rows.append((doc, len(s), int(keys[0]), int(keys[1]), sketch.tobytes(), prefix.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "n", "k1", "k2", "sketch", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, n long, k1 long, k2 long, sketch binary, prefix array<long>")


def regions(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """(pivot, doc_id): every shingle that two prefixes share has the smallest document that holds it as pivot, and all that hold it are in
    the pivot's region. Two linked documents share a prefix shingle, hence a region; a document near several pivots is in all their regions."""
    places = signed.where("n > 0 AND doc_id IS NOT NULL").select(F.explode("prefix").alias("s"), "doc_id")
    shared = places.groupBy("s").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("other")).where("pivot < other").drop("other")
    members = places.join(shared, "s").where("doc_id <> pivot").select("pivot", "doc_id").distinct()
    members = kept(members.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("pivot", "doc_id"), "members")
    return members.unionByName(members.select("pivot", F.col("pivot").alias("doc_id")).distinct())


def _values(column: pa.Array) -> list:
    """Entries of a column; lists of numbers as arrays of their own."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[i:j].copy() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of one pivot after the other, from batches in pivot order."""
    held: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        pivot = batch.column("pivot").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(pivot)) + 1
        columns = {name: _values(batch.column(i)) for i, name in enumerate(batch.schema.names)}
        for a, b in zip([0, *cuts], [*cuts, len(pivot)], strict=True):
            part = {k: v[a:b] for k, v in columns.items()}
            if held and held["pivot"][0] != part["pivot"][0]:
                yield held
                held = {}
            held = {k: held[k] + v for k, v in part.items()} if held else part
    if held:
        yield held


def may_link(n: np.ndarray, sketches: list[bytes], side: np.ndarray | None = None) -> np.ndarray:
    """Members x members: whether sizes and class counts allow a link. Sizes of linked sets differ by a third at most; class counts
    differ by no more in sum than the symmetric difference, which a link bounds by a seventh of both sizes. Sketches of
    two widths are compared at the smaller one, as the classes of the wider one fold onto it. Members of one ``side`` other than 0 are not compared."""
    out = np.zeros((len(n), len(n)), bool)
    width = np.array([len(x) for x in sketches])
    for level in np.unique(width):
        rows = np.flatnonzero((width == level) | (width == 2 * level))
        counts = np.stack([np.frombuffer(sketches[i], np.uint8).astype(np.int16).reshape(-1, level).sum(0) for i in rows])
        for at in np.flatnonzero(width[rows] == level):
            fits = (4 * n[rows] >= 3 * n[rows[at]]) & (4 * n[rows[at]] >= 3 * n[rows])
            if side is not None and side[rows[at]]:
                fits &= side[rows] != side[rows[at]]
            fits = np.flatnonzero(fits)
            apart = np.abs(counts[fits] - counts[at]).sum(1)
            ok = rows[fits[7 * apart <= n[rows[fits]] + n[rows[at]]]]
            out[rows[at], ok] = out[ok, rows[at]] = True
    np.fill_diagonal(out, False)
    return out


def _connected(near: np.ndarray) -> Iterator[np.ndarray]:
    """Members (as flags) of every component of two or more."""
    open_ = near.any(1)
    while open_.any():
        cell = np.zeros(len(near), bool)
        front = np.zeros(len(near), bool)
        front[np.argmax(open_)] = True
        while front.any():
            cell |= front
            front = near[front].any(0) & ~cell
        open_ &= ~cell
        yield cell


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of every region: members that are connected by pairs that may be linked. A cell is named by its members' hash, as the
    same documents meet in the regions of many pivots."""
    for region in _by_region(batches):
        ids, n = np.array(region["doc_id"], np.int64), np.array(region["n"], np.int64)
        cells = [(np.sort(ids[cell]), int(n[cell].sum())) for cell in _connected(may_link(n, region["sketch"]))]
        if cells:
            names = [int(mix(mix(c.view(np.uint64)) + np.arange(len(c), dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64)) for c, _ in cells]
            columns = [pa.array(names, pa.int64()), pa.array([c for c, _ in cells], pa.list_(pa.int64())), pa.array([w for _, w in cells], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "members", "weight"])


def _possible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of two blocks that meet, or of one that meets itself: each member of a component of pairs that may be linked with its first one."""
    for room in _by_region(batches):
        ids = np.array(room["doc_id"], np.int64)
        cells = [ids[cell] for cell in _connected(may_link(np.array(room["n"], np.int64), room["sketch"], np.array(room["side"])))]
        if cells:
            pairs = [pa.array(np.concatenate(x), pa.int64()) for x in ([np.full(len(c) - 1, c[0]) for c in cells], [c[1:] for c in cells])]
            yield pa.RecordBatch.from_arrays(pairs, names=["a", "b"])


def crowded_cells(described: DataFrame) -> DataFrame:
    """(pivot, doc_id, weight): cells of regions too large for a task, named by their smallest member, and the shingles of each.

    Members are dealt by band of size and by hash into blocks, and a block meets those of its own and of the next band, so all pairs that sizes
    allow are compared, in tasks of two blocks whatever the region's size. A meeting returns fewer pairs than it has members.
    """
    rows = described.select("pivot", "doc_id", "n", "sketch", F.floor(F.log("n") / math.log(BAND)).alias("band"))
    parts = kept(rows.groupBy("pivot", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), "bands")
    own = rows.join(parts, ["pivot", "band"]).withColumn("block", F.struct("band", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"))).drop("parts")
    asked = own.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))).join(parts, ["pivot", "band"])
    other = asked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("other", F.struct("band", F.col("other").alias("part")))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(2)
    rooms = other.select(F.xxhash64("pivot", low, high).alias("pivot"), "doc_id", "n", "sketch", side.alias("side"))
    pairs = rooms.repartition("pivot").sortWithinPartitions("pivot").mapInArrow(frugal(_possible_pairs), "a long, b long")
    found = components(pairs).join(described.groupBy("doc_id").agg(F.max("n").alias("n")), F.col("node") == F.col("doc_id"))
    found = kept(found.select(F.col("component").alias("pivot"), "doc_id", "n"), "crowded")
    return found.join(found.groupBy("pivot").agg(F.sum("n").alias("weight")), "pivot").select("pivot", "doc_id", "weight")


class Cells:
    """Joins the members of one region: union-find over members, distances by set intersection."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        self.parent = list(range(len(sets)))

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def common(self, pivot: int, others: np.ndarray) -> np.ndarray:
        flat = np.concatenate([self.sets[i] for i in others])
        own = self.sets[pivot]
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        return np.add.reduceat(hit.astype(np.int64), np.cumsum(self.size[others]) - self.size[others])

    def meet(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Distances of others to a pivot; links are kept."""
        common = self.common(pivot, others)
        for i in others[linked(common, self.size[pivot], self.size[others])]:
            a, b = self.find(pivot), self.find(int(i))
            self.parent[max(a, b)] = min(a, b)
        return 1 - common / (self.size[pivot] + self.size[others] - common)

    def join(self, cell: np.ndarray) -> None:
        """All links of a cell, up to those between members that links join already.

        Pivots split a large cell by the nearest of them. A member goes to another pivot's cell too if it is within the window that a
        partner at home there allows: its distance exceeds neither its own nearest one by 2 NEAR nor the cell's radius by NEAR.
        Members at 1 - NEAR or more from all pivots form a cell of their own. Pivots have met everyone and leave. Where cells
        overlap so much that splitting does not pay, members meet one by one.
        """
        if len(cell) > LEAF:
            spread = np.unique(np.linspace(0, len(cell) - 1, min(16, len(cell) // LEAF + 1)).astype(int))
            rest = np.delete(cell, spread)
            d = np.stack([self.meet(int(cell[p]), cell)[np.setdiff1d(np.arange(len(cell)), spread)] for p in spread])
            home, nearest = d.argmin(0), d.min(0)
            core = nearest < 1 - NEAR
            parts = [rest[~core]]
            for j in range(len(spread)):
                own = core & (home == j)
                if own.any():
                    radius = nearest[own].max()
                    parts.append(rest[(d[j] <= np.minimum(nearest + 2 * NEAR, radius + NEAR) + 1e-9) & (d[j] < 1)])
            parts = [p for p in parts if len(p) > 1 and len({self.find(int(i)) for i in p}) > 1]
            if sum(map(len, parts)) <= 1.5 * len(cell):
                for p in parts:
                    self.join(p)
                return
            cell = rest
        for i in range(len(cell) - 1):
            u = int(cell[i])
            later = cell[i + 1 :]
            a = self.find(u)
            fits = (4 * self.size[later] >= 3 * self.size[u]) & (4 * self.size[u] >= 3 * self.size[later])
            others = np.array([int(x) for x in later[fits] if self.find(int(x)) != a], np.int64)
            if len(others):
                self.meet(u, others)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of whole regions: each member with the first of its component."""
    for region in _by_region(batches):
        sets = [s.view(np.uint64) for s in region["s"]]
        cells = Cells(sets)
        cells.join(np.arange(len(sets)))
        ids = [int(i) for i in region["doc_id"]]
        pairs = [(ids[i], ids[cells.find(i)]) for i in range(len(ids)) if cells.find(i) != i]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def set_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, s): sorted shingles of the documents in ``wanted``. A fixed-size key filter keeps most others from being shingled at all."""
    sent = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sent.value.maybe(_ids(batch).to_numpy(zero_copy_only=False))))
            for part in text_slices(batch, limit=TEXT):
                sets = shingle_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([_ids(part), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "s"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(frugal(run), "doc_id long, s array<long>").where(F.size("s") > 0)


def join_large(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of cells too large for a task. Rounds: up to PIVOTS members of a cell that are not known to be connected with its
    first pivot meet all members, spread over SALTS parts of the cell, until each has met all or is connected. Pairs of
    connected members need no test, so a cell of copies ends after few rounds, whatever its size."""
    spark = members.sparkSession
    state = kept(members.withColumns({"main": F.col("doc_id") == F.col("pivot"), "done": F.lit(False)}), "large")
    links = spark.createDataFrame([], "a long, b long")
    while True:
        region = W.Window.partitionBy("pivot")
        waiting = state.where(~F.col("done") & (~F.col("main") | (F.col("doc_id") == F.col("pivot"))))
        waiting = waiting.withColumns({"nth": F.row_number().over(region.orderBy(F.col("main").desc(), F.xxhash64("doc_id"))), "first": F.max("main").over(region)})
        asked = waiting.where(F.col("nth") <= F.when(F.col("first"), 1).otherwise(PIVOTS))
        asked = kept(asked.select("pivot", F.col("doc_id").alias("q"), "main"), "large")
        if asked.isEmpty():
            return links
        q_sets = asked.join(sets.select(F.col("doc_id").alias("q"), F.col("s").alias("qs")), "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts = state.join(asked.select("pivot").distinct(), "pivot", "left_semi").join(sets, "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        common = F.size(F.array_intersect("s", "qs"))
        found = parts.join(q_sets.select("pivot", "salt", "q", "qs"), ["pivot", "salt"]).where(F.col("doc_id") != F.col("q"))
        found = kept(found.where(linked(common, F.size("s"), F.size("qs"))).select("pivot", "q", "doc_id", F.col("main").alias("to_main")), "large")
        connected = found.where("to_main").select("pivot", "q").unionByName(asked.where("main").select("pivot", "q")).distinct()
        reached = found.join(connected, ["pivot", "q"], "left_semi").select("pivot", "doc_id").unionByName(connected.withColumnRenamed("q", "doc_id")).distinct().withColumn("hit", F.lit(True))
        met = asked.select("pivot", F.col("q").alias("doc_id"), F.lit(True).alias("met"))
        links = kept(links.unionByName(found.select(F.col("q").alias("a"), F.col("doc_id").alias("b"))), "large")
        state = state.join(reached, ["pivot", "doc_id"], "left").join(met, ["pivot", "doc_id"], "left").select(
            "pivot", "doc_id", (F.col("main") | F.coalesce("hit", F.lit(False))).alias("main"), (F.col("done") | F.coalesce("met", F.lit(False))).alias("done"))
        state = kept(state, "large")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents whose shingle sets have a Jaccard similarity of 0.75 or more are linked,
    a component is named after its smallest doc_id. Exact, up to collisions of 64-bit shingle hashes.

    1 - similarity is a metric, but nearly all documents are at distance 1 from each other, so cells around pivots drawn at
    random would not separate them. Pivots are drawn where documents meet: equal sets are one node; of every shingle that prefixes
    share, the smallest document is a pivot and its holders are its region (``regions``); the prefixes are the rarest quarter of a set, so passages
    that many documents share do not make regions. Members whose class counts put them too far from all others leave, and what is left of a
    region falls into cells of documents that may be near each other; a cell that several regions have is kept once. Regions too large for a
    task are compared block by block (``crowded_cells``). Cells are joined
    recursively around pivots with triangle-inequality windows (``Cells``), large ones over all tasks (``join_large``), and the links'
    components are found by star rounds.

    Null and empty texts have 0 shingles and are components of their own; a null doc_id has its equals' component or null; rows with
    one doc_id are one node; columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    signed = kept(signatures(docs, hot_shingles(docs)), "signatures")
    keys = ["k1", "k2", "n"]
    reps = kept(signed.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")
    members = regions(signed, reps)
    sizes = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"))
    described = members.join(sizes, "pivot").join(signed.where("n > 0").select("doc_id", "n", "sketch"), "doc_id").select("pivot", "doc_id", "n", "sketch", "m")
    possible = described.where(F.col("m") <= REGION).select("pivot", "doc_id", "n", "sketch").repartition("pivot").sortWithinPartitions("pivot")
    cells = kept(possible.mapInArrow(frugal(_possible), "cell long, members array<long>, weight long").dropDuplicates(["cell"]), "cells")
    small = cells.where(F.col("weight") <= CELL).select(F.col("cell").alias("pivot"), F.explode("members").alias("doc_id"))
    heavy = cells.where(F.col("weight") > CELL).select(F.array_min("members").alias("pivot"), F.explode("members").alias("doc_id"))
    crowded = described.where(F.col("m") > REGION)
    if not sizes.where(F.col("m") > REGION).isEmpty():
        more = kept(crowded_cells(crowded), "cells")
        small = small.unionByName(more.where(F.col("weight") <= CELL).drop("weight"))
        heavy = heavy.unionByName(more.where(F.col("weight") > CELL).drop("weight"))
    large = kept(heavy.distinct(), "cells")
    sets = set_table(docs, small.select("doc_id").unionByName(large.select("doc_id")).distinct())
    ready = small.join(sets, "doc_id").select("pivot", "doc_id", "s").repartition("pivot").sortWithinPartitions("pivot")
    links = ready.mapInArrow(frugal(_joined), "a long, b long")
    if not large.isEmpty():
        links = links.unionByName(join_large(large, kept(sets.join(large.select("doc_id").distinct(), "doc_id", "left_semi"), "sets")))
    found = components(links)
    placed = signed.select("doc_id", *keys).join(reps, keys, "left").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group that ``jaccard_components`` links: the one of smallest doc_id, in all columns as it was.

    A row is told by doc_id and text, so different texts under one doc_id are linked as different documents, and each stays unless a link
    takes it. Rows that also share the text stay once, the one whose other columns have the smallest hash. Rows without words are linked
    with nothing and all stay, rows without doc_id are documents like others, behind those with one. What goes is joined, not what stays.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    several = kept(ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").select("id"), "repeated")
    if several.isEmpty():
        gone = kept(jaccard_components(docs).where("n_shingles > 0 AND doc_id <> component_id").select("doc_id"), "copies")
        return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    text = F.col("row.text")
    again = several.withColumnRenamed("id", "again")
    repeated = rows.join(again, rows["id"].eqNullSafe(again["again"]), "left_semi").select("id", F.sha2(text, 256).alias("sha")).distinct()
    lowest = F.least(F.lit(0), F.coalesce(several.select(F.min("id")).scalar(), F.lit(0)), F.coalesce(ids.select(F.min("id")).scalar(), F.lit(0)))
    own = kept(kept(repeated.withColumn("nth", F.monotonically_increasing_id()), "repeated").select(F.col("id").alias("of"), "sha", (lowest - 1 - F.col("nth")).alias("own")), "keys")
    same = rows["id"].eqNullSafe(own["of"]) & F.sha2(text, 256).eqNullSafe(own["sha"])
    keyed = rows.join(own, same, "left").select("row", F.coalesce("own", "id").alias("key"), F.col("own").isNotNull().alias("repeated"))
    found = kept(jaccard_components(keyed.select(F.col("key").alias("doc_id"), text.alias("text"))).where("n_shingles > 0").distinct(), "components")
    of = own.select(F.col("own").alias("doc_id"), "of", F.lit(True).alias("renamed"))
    real = F.when(F.col("renamed"), F.col("of")).otherwise(F.col("doc_id"))
    first = F.min(F.struct(real.isNull().alias("last"), real.alias("id"), F.col("doc_id").alias("key"))).alias("first")
    stays = found.join(of, "doc_id", "left").groupBy("component_id").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", F.col("first.key").alias("stays"))
    gone = kept(found.join(stays, "component_id").where("doc_id <> stays").select(F.col("doc_id").alias("key")), "copies")
    left = keyed.join(gone, "key", "left_anti")
    once = F.col("repeated") & F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    others = F.xxhash64(*[F.to_json(F.struct(F.col("row").getField(c).alias("x"))) for c in docs.columns if c != "text"])
    single = left.where(once).groupBy("key").agg(F.min_by("row", others).alias("row"))
    return left.where(~once).select("row").unionByName(single.select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

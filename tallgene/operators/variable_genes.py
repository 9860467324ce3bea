"""Variable genes of raw counts: variance over a local regression on the mean, and clipped residuals of a count model.

Both work on sums over nonzero entries; zeros of absent entries are added through the number of cells (``seurat_v3``) or through the
histogram of cell totals (``pearson_residuals``). No table of cells by genes is made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.lineage import stable
from tallgene.functions.ranks import meet

#: Genes or distinct totals that meet in one task.
TILE = 1024
MOMENTS = ["s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"]
#: Power sums of x, and of y by powers of x, that a node of tiles keeps: those of a moment and of the tricube's polynomial. Largest node: 2 ** LEVELS tiles.
POWERS, Y_POWERS, LEVELS = 14, 12, 10


def _schema(df: DataFrame, cols: Sequence[str], more: str) -> str:
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols]
    return ", ".join([*kept, more])


def _meetings(left: DataFrame, right: DataFrame, keys: list[str]):
    """Groups of equal keys of two frames that may come from one table; columns of the right one get the prefix ``r_``."""
    other = right.toDF(*[f"r_{c}" for c in right.columns])
    return left.groupBy(*keys).cogroup(other.groupBy(*[f"r_{c}" for c in keys]))


def _windows(ranked: DataFrame, by: list[str]) -> DataFrame:
    """``ranked`` (by, _r, x, y, _q) with the bandwidth ``h`` of each point, the distance of its q-th nearest, and the ranks of these q points.

    The q nearest are q consecutive ranks. Of all such runs, in the order of the middle of their ends, the last one whose middle is not beyond
    the point and the first one behind it are the candidates, so that running values over points and middles together find them.
    """
    ends = ranked.select(*by, (F.col("_r") - F.col("_q") + 1).alias("_lo"), F.col("_r").alias("_hi"), F.col("x").alias("_xhi")).where("_lo >= 0")
    begins = ranked.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_r").alias("_from"), F.col("x").alias("_xlo"))
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    runs = ends.join(begins, [*same, F.col("_lo") == F.col("_from")]).select(
        *by, ((F.col("_xlo") + F.col("_xhi")) / 2).alias("_at"), F.lit(0).alias("_point"), F.struct("_xlo", "_xhi", "_lo", "_hi").alias("_run"))
    points = ranked.select(*by, F.col("x").alias("_at"), F.lit(1).alias("_point"), F.struct("_r", "x", "y").alias("_p"))
    both = runs.unionByName(points, allowMissingColumns=True)
    upward = Window.partitionBy(*by).orderBy("_at", "_point", "_p._r", "_run._lo").rowsBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy(*by).orderBy(F.desc("_at"), "_point", "_p._r", F.desc("_run._lo")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_low", F.last("_run", ignorenulls=True).over(upward)).withColumn("_high", F.last("_run", ignorenulls=True).over(downward)).where("_point = 1")
    x = F.col("_p.x")
    low, high = x - F.col("_low._xlo"), F.col("_high._xhi") - x
    run = F.when(F.col("_high").isNull() | (low <= high), F.col("_low")).otherwise(F.col("_high"))
    return found.withColumn("_best", run).select(*by, "_p._r", "_p.x", "_p.y", F.least(low, high).alias("h"), "_best._lo", "_best._hi")


def _tile_moments(by: list[str]):
    def run(targets: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        if not len(targets) or not len(sources):
            return targets[[*by, "_r"]].head(0).assign(**{m: 0.0 for m in MOMENTS})  # keys keep their types: Arrow turns no empty numbers into text
        d = sources["r_x"].to_numpy()[None] - targets["x"].to_numpy()[:, None]
        h = targets["h"].to_numpy()[:, None]
        u = np.divide(d, h, out=np.where(d == 0, 0.0, 2.0), where=h > 0)
        w = np.where(np.abs(u) < 1, (1 - np.minimum(np.abs(u), 1) ** 3) ** 3, 0.0)
        y = sources["r_y"].to_numpy()[None]
        sums = {}
        for k in range(5):
            sums[f"s{k}"] = w.sum(1)
            if k < 3:
                sums[f"t{k}"] = (w * y).sum(1)
            w = w * u
        return pd.DataFrame({**{c: targets[c].to_numpy() for c in by}, "_r": targets["_r"].to_numpy(), **{m: sums[m] for m in MOMENTS}})

    return run


def _shifted(a: np.ndarray, b: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Sums of (a v + b) ** p by p and point, from the ``sums`` of v ** p, one row for all points or one each."""
    n = sums.shape[-1]
    left, right = np.ones((n, len(a))), np.ones((n, len(a)))
    for p in range(1, n):
        left[p], right[p] = left[p - 1] * a, right[p - 1] * b
    left *= sums.T if sums.ndim > 1 else sums[:, None]
    return np.array([sum(math.comb(p, m) * left[m] * right[p - m] for m in range(p + 1)) for p in range(n)])


NODE = "c double, r double, px array<double>, py array<double>"


def _node(keys: pd.DataFrame, low: float, high: float, sums) -> pd.DataFrame:
    center = (low + high) / 2
    px, py = sums(center, (high - low) / 2 or 1.0)
    return keys.head(1).assign(c=center, r=(high - low) / 2, px=[px], py=[py])


def _tile_sums(keys: list[str]):
    """A tile's power sums about the middle of its x, in units of half its width, so that no power is beyond 1."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["x"].to_numpy(), part["y"].to_numpy()

        def sums(center: float, width: float):
            v = ((x - center) / width)[None] ** np.arange(POWERS)[:, None]
            return v.sum(1), (v[:Y_POWERS] * y).sum(1)

        return _node(part[keys], x.min(), x.max(), sums)

    return run


def _node_sums(keys: list[str]):
    """The power sums of a node from those of its tiles."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        c, r = part["c"].to_numpy(), part["r"].to_numpy()

        def sums(center: float, width: float):
            return tuple(_shifted(r / width, (c - center) / width, np.vstack(part[col])).sum(1) for col in ("px", "py"))

        return _node(part[keys], (c - r).min(), (c + r).max(), sums)

    return run


def _far_moments(by: list[str]):
    """Moments of targets over nodes that lie inside all their windows, on one side of them: there the tricube is a polynomial of the distance."""
    def run(targets: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(targets) or not len(nodes):
            return targets[[*by, "_r"]].head(0).assign(**{m: 0.0 for m in MOMENTS})
        x, h = targets["x"].to_numpy(), targets["h"].to_numpy()
        h = np.where(h > 0, h, 1.0)
        sums = {m: np.zeros(len(x)) for m in MOMENTS}
        for c, r, side, px, py in zip(*(nodes[f"r_{k}"] for k in ("c", "r", "_side", "px", "py")), strict=True):
            for name, powers, n in (("s", px, 5), ("t", py, 3)):
                u = _shifted(r / h, (c - x) / h, np.asarray(powers))
                for k in range(n):
                    sums[f"{name}{k}"] += u[k] - 3 * side * u[k + 3] + 3 * u[k + 6] - side * u[k + 9]
        return pd.DataFrame({**{c: targets[c].to_numpy() for c in by}, "_r": targets["_r"].to_numpy(), **sums})

    return run


def _halves(first: Column, last: Column, side: int) -> Column:
    """Nodes (side, level, node) that make up the tiles first..last: where a border is odd at a level, its node stands alone there."""
    found = []
    for level in range(LEVELS + 1):
        low, high = F.ceil(first / (1 << level)), F.floor((last + 1) / (1 << level))
        at = lambda c: F.array(F.struct(F.lit(side).alias("_side"), F.lit(level).alias("_level"), c.cast("long").alias("_node")))  # noqa: B023, E731
        none = F.array().cast("array<struct<_side:int,_level:int,_node:bigint>>")
        if level == LEVELS:
            found.append(F.when(low < high, F.transform(F.sequence(low, high - 1), lambda c: at(c)[0])).otherwise(none))
        else:
            found += [F.when((low < high) & (edge % 2 == 1), at(c)).otherwise(none) for edge, c in ((low, low), (high, high - 1))]
    return F.concat(*found)


def local_quadratic(points: DataFrame, by: Sequence[str], key: str, span: float) -> DataFrame:
    """``points`` (by, key, x, y) with ``fit``: local quadratic regression of y on x at every point, tricube weights over its q = span * n nearest.

    Points are ranked by x within a group and cut into tiles of TILE. A tile meets itself and the tiles that the ends of its windows fall into,
    a number in proportion to the tiles, and gets weighted moments back. What lies between is inside all its windows and on one side, where the weight is
    a polynomial of the distance: few nodes of 2 ** level tiles stand for it by their power sums. No pair of points becomes a row.
    Windows with fewer than three distinct x fall back to a line or a mean.
    """
    by = list(by)
    order = Window.partitionBy(*by).orderBy("x", key)
    q = F.least(F.col("_n"), F.greatest(F.lit(3), F.floor(F.col("_n") * span + 1e-5)))
    ranked = points.select(*by, key, "x", "y", (F.row_number().over(order) - 1).cast("long").alias("_r"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("_n"))
    ranked = stable(ranked.withColumn("_q", q.cast("long")))
    windows = stable(_windows(ranked.select(*by, "_r", "x", "y", "_q"), by).withColumn("_t", F.floor(F.col("_r") / TILE)))
    reach = stable(windows.groupBy(*by, "_t").agg(*[F.floor(f(c) / TILE).alias(n) for f, c, n in (
        (F.min, "_lo", "_first"), (F.max, "_lo", "_from"), (F.min, "_hi", "_to"), (F.max, "_hi", "_last"))]))
    t, first, last = F.col("_t"), F.col("_from") + 1, F.col("_to") - 1
    ends = F.array_distinct(F.concat(F.sequence("_first", "_from"), F.array("_t"), F.sequence("_to", "_last")))
    pairs = reach.select(*by, "_t", F.explode(F.when(first > last, F.sequence("_first", "_last")).otherwise(ends)).alias("_u"))
    targets = meet(windows.select(*by, "_t", "_r", "x", "h"), pairs, [*by, "_t"])
    cut = ranked.select(*by, F.floor(F.col("_r") / TILE).alias("_u"), "x", "y")
    sources = meet(cut, pairs, [*by, "_u"])
    keys = [*by, "_t", "_u"]
    schema = _schema(ranked, [*by, "_r"], ", ".join(f"{m} double" for m in MOMENTS))
    near = _meetings(targets, sources, keys).applyInPandas(_tile_moments(by), schema)
    tiles = cut.groupBy(*by, "_u").applyInPandas(_tile_sums([*by, "_u"]), _schema(cut, [*by, "_u"], NODE))
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("_level"), F.floor(F.col("_u") / F.pow(F.lit(2.0), k)).alias("_node"))))
    tiles = tiles.withColumn("_of", above).select(*by, "_of.*", "c", "r", "px", "py")
    node = [*by, "_level", "_node"]
    nodes = tiles.groupBy(*node).applyInPandas(_node_sums(node), _schema(tiles, node, NODE))
    halves = F.concat(_halves(first, F.least(last, t - 1), -1), _halves(F.greatest(first, t + 1), last, 1))
    inside = meet(reach.select(*by, "_t", F.explode(halves).alias("_h")).select(*by, "_t", "_h.*"), nodes, node).select(*by, "_t", "_side", "c", "r", "px", "py")
    far = _meetings(windows.select(*by, "_t", "_r", "x", "h"), inside, [*by, "_t"]).applyInPandas(_far_moments(by), schema)
    sums = near.unionByName(far).groupBy(*by, "_r").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    return meet(ranked.select(*by, key, "_r"), sums, [*by, "_r"]).select(*by, key, _intercept().alias("fit"))


def _intercept() -> Column:
    """Value at 0 of the weighted least-squares parabola, or line, or mean, whichever the moments determine."""
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(m) for m in MOMENTS)
    square = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    line = s0 * s2 - s1 * s1
    parabola = (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / square
    return F.when(square > 1e-10 * s0 * s0 * s0, parabola).when(line > 1e-10 * s0 * s0, (t0 * s2 - t1 * s1) / line).otherwise(t0 / s0)


def _with_batch(expr: DataFrame, obs: DataFrame, batch: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries (batch, cell_id, gene, value) of known cells, and cells per batch."""
    cells = obs.select("cell_id", *batch)
    entries = expr.where("value <> 0").join(cells, "cell_id").select(*batch, "cell_id", "gene", F.col("value").cast("double").alias("value"))
    return entries, cells.groupBy(*batch).agg(F.count(F.lit(1)).alias("n_cells"))


def standardized_variance(expr: DataFrame, obs: DataFrame, batch: Sequence[str] = (), span: float = 0.3) -> DataFrame:
    """(batch, gene, mean, variance, variance_norm) of raw counts: the variance of values standardised by the fitted deviation, clipped at the
    root of the number of cells.

    The fit is of log10 variance on log10 mean. Zeros are never beyond the clip, so the clipped sums are those of all entries less
    what few entries are beyond it, and only entries above the least clip of all genes meet the gene table. Genes of no variance have 0.
    """
    batch = list(batch)
    entries, sizes = _with_batch(expr, obs, batch)
    x = F.col("value")
    sums = entries.groupBy(*batch, "gene").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    n = F.col("n_cells")
    mean = F.col("s") / n
    stats = meet(sums, sizes, batch) if batch else sums.crossJoin(F.broadcast(sizes))  # sizes is one row without batches
    stats = stable(stats.withColumns({"mean": mean, "variance": F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * mean) / (n - 1))}).where("n_cells > 1"))
    points = stats.where("variance > 0 AND mean > 0").select(*batch, "gene", F.log10("mean").alias("x"), F.log10("variance").alias("y"))
    fitted = local_quadratic(points, batch, "gene", span)
    deviation = F.sqrt(F.pow(F.lit(10.0), F.col("fit")))
    clipped = stable(meet(stats, fitted, [*batch, "gene"], "left").withColumn("sd", F.coalesce(deviation, F.lit(1.0))).withColumn("clip", F.col("sd") * F.sqrt("n_cells") + F.col("mean")).drop("fit"))
    least = clipped.select(F.min("clip")).scalar()
    beyond = meet(entries.where(x > least), clipped.select(*batch, "gene", "clip"), [*batch, "gene"]).where("value > clip")
    beyond = beyond.groupBy(*batch, "gene").agg(F.sum(x - F.col("clip")).alias("_s"), F.sum(x * x - F.col("clip") * F.col("clip")).alias("_ss"))
    both = meet(clipped, beyond, [*batch, "gene"], "left")
    s, ss = F.col("s") - F.coalesce("_s", F.lit(0.0)), F.col("ss") - F.coalesce("_ss", F.lit(0.0))
    norm = (n * F.col("mean") * F.col("mean") + ss - 2 * s * F.col("mean")) / ((n - 1) * F.col("sd") * F.col("sd"))
    return both.select(*batch, "gene", "mean", "variance", F.when(F.col("variance") > 0, norm).otherwise(0.0).alias("variance_norm"))


def _zero_sums(by: list[str], theta: float):
    def run(genes: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(genes) or not len(totals):
            return genes[[*by, "gene"]].head(0).assign(z1=0.0, z2=0.0)
        mu = genes["p"].to_numpy()[:, None] * totals["r_total"].to_numpy()[None]
        z = np.minimum(np.sqrt(mu / (1 + mu / theta)), totals["r_limit"].to_numpy()[None])
        cells = totals["r_cells"].to_numpy(float)
        return pd.DataFrame({**{c: genes[c].to_numpy() for c in by}, "gene": genes["gene"].to_numpy(), "z1": -(z @ cells), "z2": (z * z) @ cells})

    return run


def residual_variance(expr: DataFrame, obs: DataFrame, batch: Sequence[str] = (), theta: float = 100.0, clip: float | None = None) -> DataFrame:
    """(batch, gene, mean, variance, variance_norm) of raw counts: ``variance_norm`` is the variance over all cells of the residuals
    (x - mu) / sqrt(mu + mu^2 / theta), mu = total of the cell * share of the gene, clipped at ``clip``, by default the root of the number of cells.

    The residual of a zero depends on the cell's total alone: its sums over all cells come from the histogram of totals, tile by tile, and
    entries add their difference to it. Cells without counts have residual 0.
    """
    batch = list(batch)
    entries, sizes = _with_batch(expr, obs, batch)
    totals = stable(entries.groupBy(*batch, "cell_id").agg(F.sum("value").alias("total")))
    x = F.col("value")
    sums = entries.groupBy(*batch, "gene").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    whole = sizes.withColumn("limit", F.lit(float(clip)) if clip is not None else F.sqrt("n_cells"))
    mass = totals.groupBy(*batch).agg(F.sum("total").alias("mass"))
    whole = stable(meet(whole, mass, batch) if batch else whole.crossJoin(mass))  # one row each without batches
    genes = meet(sums, whole, batch) if batch else sums.crossJoin(F.broadcast(whole))
    genes = stable(genes.withColumn("p", F.col("s") / F.col("mass")).where("p > 0").withColumn("_g", F.xxhash64("gene")))
    counted = totals.groupBy(*batch, "total").agg(F.count(F.lit(1)).alias("cells")).where("total > 0")
    counted = stable((meet(counted, whole, batch) if batch else counted.crossJoin(F.broadcast(whole))).select(*batch, "total", "cells", "limit", F.xxhash64("total").alias("_h")))
    parts = lambda df: max(1, -(-df.count() // TILE))
    ng, nt = parts(genes), parts(counted)
    left = genes.select(*batch, "gene", "p", F.pmod("_g", F.lit(ng)).alias("_gt"), F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("_tt"))
    right = counted.select(*batch, "total", "cells", "limit", F.pmod("_h", F.lit(nt)).alias("_tt"), F.explode(F.sequence(F.lit(0), F.lit(ng - 1))).alias("_gt"))
    keys = [*batch, "_gt", "_tt"]
    zeros = _meetings(left, right, keys).applyInPandas(_zero_sums(batch, theta), _schema(genes, [*batch, "gene"], "z1 double, z2 double"))
    zeros = zeros.groupBy(*batch, "gene").agg(F.sum("z1").alias("z1"), F.sum("z2").alias("z2"))
    told = meet(entries, totals, [*batch, "cell_id"])
    told = meet(told, genes.select(*batch, "gene", "p", "limit"), [*batch, "gene"]).withColumn("mu", F.col("total") * F.col("p"))
    inside = lambda c: F.greatest(-F.col("limit"), F.least(F.col("limit"), c))
    scale = F.sqrt(F.col("mu") + F.col("mu") * F.col("mu") / theta)
    told = told.withColumns({"r": inside((x - F.col("mu")) / scale), "z": inside(-F.col("mu") / scale)})
    more = told.groupBy(*batch, "gene").agg(F.sum(F.col("r") - F.col("z")).alias("d1"), F.sum(F.col("r") * F.col("r") - F.col("z") * F.col("z")).alias("d2"))
    n = F.col("n_cells")
    first, second = (F.col("z1") + F.col("d1")) / n, (F.col("z2") + F.col("d2")) / n
    mean = F.col("s") / n
    return meet(meet(genes, zeros, [*batch, "gene"]), more, [*batch, "gene"]).select(
        *batch, "gene", mean.alias("mean"), F.when(n > 1, (F.col("ss") - F.col("s") * mean) / (n - 1)).alias("variance"), F.greatest(F.lit(0.0), second - first * first).alias("variance_norm"))


def top_by_variance(scored: DataFrame, batch: Sequence[str], n_top_genes: int, batches_first: bool) -> DataFrame:
    """Top genes of one or many batches: ranks of ``variance_norm`` in each batch (to nine digits, ties by gene), the median of the ranks below ``n_top_genes``, and the
    number of batches that have such a rank decide. ``batches_first`` orders by that number before the median, else behind it.

    Columns gene, mean, variance, variance_norm (means over batches), n_batches_variable, rank (median from 0, null if none) and highly_variable.
    """
    within = Window.partitionBy(*batch).orderBy(F.round("variance_norm", 9).desc_nulls_last(), "gene")
    ranked = scored.withColumn("_rank", F.row_number().over(within) - 1).withColumn("_rank", F.when(F.col("_rank") < n_top_genes, F.col("_rank")))
    g = ranked.groupBy("gene").agg(
        *[F.avg(c).alias(c) for c in ("mean", "variance", "variance_norm")], F.count("_rank").alias("n_batches_variable"), F.percentile("_rank", F.lit(0.5)).alias("rank"))
    keys = [F.col("rank").asc_nulls_last(), F.col("n_batches_variable").desc()]
    order = Window.orderBy(*(keys[::-1] if batches_first else keys), F.round("variance_norm", 9).desc_nulls_last(), "gene")
    return g.withColumn("highly_variable", F.row_number().over(order) <= n_top_genes)

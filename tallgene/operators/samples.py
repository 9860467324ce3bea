"""Per-sample transforms on aligned arrays (survey section 2.9).

A sample is one row ``(cell_id, items)`` with ``items: array<struct<gene, value, ...>>``, so that
fields cannot drift apart; its length is bounded by the gene list. Operators are array expressions;
those that need a table join explode, join and collect again in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgene.functions.lineage import stable
from tallgene.functions.lists import halving_steps, in_sorted
from tallgene.functions.rand import hash_int, hash_text, hash_uniform


def build_samples(rows, *fields: str, order: str = "gene") -> DataFrame:
    """arr_build: long rows to one row per cell, items in gene order."""
    fields = fields or ("value",)
    item = F.struct(F.col(order).alias("_o"), F.struct("gene", *fields).alias("x"))
    return rows.groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["x"]).alias("items"))


def item_rows(samples, *keep: str) -> DataFrame:
    """Samples back to long rows with the position of every item."""
    # the outer form: the plain one first asks whether there are items, and for that makes the whole list of a transform a second time
    made = samples.select("cell_id", *keep, F.posexplode_outer("items").alias("pos", "i")).where("pos IS NOT NULL")
    return made.select("cell_id", *keep, "pos", "i.*")


def collect_rows(rows, *fields: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Inverse of :func:`item_rows`: items ordered by ``pos``."""
    item = F.struct("pos", F.struct("gene", *fields).alias("x"))
    return rows.groupBy("cell_id", *keep).agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["x"]).alias("items"))


def sort_items(samples, key: Callable[[Column], Column], descending: bool = False) -> DataFrame:
    """Order items by a numeric key of the item, ties in the present order."""
    keyed = F.transform("items", lambda x, i: F.struct((-key(x) if descending else key(x)).alias("k"), i.alias("i"), x.alias("x")))
    return samples.withColumn("items", F.transform(F.sort_array(keyed), lambda s: s["x"]))


def sort_by_value(samples) -> DataFrame:
    return sort_items(samples, lambda x: x["value"], descending=True)


def shuffle(samples, seed=0) -> DataFrame:
    """arr_shuffle: all fields permuted together, by the hash of (cell, gene)."""
    return sort_items(samples, lambda x: hash_int(seed, F.col("cell_id"), x["gene"]))


def truncate(samples, n: int) -> DataFrame:
    """arr_truncate."""
    return samples.withColumn("items", F.slice("items", 1, n))


def remap(samples, mapping) -> DataFrame:
    """arr_remap: genes through a table (gene, new_gene); a gene without an entry is an error."""
    rows = item_rows(samples).join(mapping.select("gene", "new_gene"), "gene", "left")
    msg = F.concat(F.lit("no mapping for "), "gene")
    named = F.when(F.col("new_gene").isNull(), F.raise_error(msg)).otherwise(F.col("new_gene"))
    return collect_rows(rows.withColumn("gene", named), "value")


def limit_tokens(samples, tokens) -> DataFrame:
    """arr_limit_tokens: whole items whose gene is listed."""
    return collect_rows(item_rows(samples).join(tokens.select("gene"), "gene", "left_semi"), "value")


def dropout(samples, p: float, seed=0) -> DataFrame:
    """arr_dropout: every item leaves with probability p."""
    return samples.withColumn("items", F.filter("items", lambda x: hash_uniform(seed, F.col("cell_id"), x["gene"]) >= p))


def dropout_chunk(samples, size: int, first: int = 0, last: int | None = None, seed=0) -> DataFrame:
    """arr_dropout_chunk: one contiguous block inside positions first..last leaves; a too long block changes nothing."""
    n = F.size("items")
    end = n - 1 if last is None else F.least(F.lit(last), n - 1)
    room = end - F.lit(first) + 1
    start = F.lit(first) + F.floor(hash_uniform(seed, "cell_id") * (room - size + 1)).cast("int")
    cut = F.filter("items", lambda x, i: (i < F.col("_s")) | (i >= F.col("_s") + size))
    out = samples.withColumns({"_s": start, "_ok": room >= size})
    return out.withColumn("items", F.when(F.col("_ok"), cut).otherwise(F.col("items"))).drop("_s", "_ok")


def dropout_selective(samples, weights, fraction: float, seed=0) -> DataFrame:
    """arr_dropout_selective: drop probability f*w/(1+f*(w-1)), w = weight over the sample's mean weight."""
    rows = item_rows(samples).join(weights.select("gene", "weight"), "gene")
    w = F.col("weight") / F.avg("weight").over(Window.partitionBy("cell_id"))
    rows = rows.withColumn("_w", w)
    prob = fraction * F.col("_w") / (1 + fraction * (F.col("_w") - 1))
    return collect_rows(rows.where(hash_uniform(seed, "cell_id", "gene") > prob), "value")


def expression_repeats(expr, locations, n: int, seed=0) -> DataFrame:
    """arr_uce: n genes drawn with log1p weights, ordered by shuffled chromosome, then start.

    Draws and cumulative weights are merged on one line per cell, and every draw takes the last gene
    that starts before it: no pair of draw and gene is made.
    """
    w = F.log1p("value")
    genes = expr.join(locations.select("gene", "chromosome", "start"), "gene").where(F.col("value") > 0)
    up = Window.partitionBy("cell_id").orderBy("gene")
    placed = genes.withColumns({
        "at": F.coalesce(F.sum(w).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "total": F.sum(w).over(Window.partitionBy("cell_id")),
    })
    one = placed.select("cell_id", "at", F.lit(0).alias("draw"), F.struct("gene", "value", "chromosome", "start").alias("g"))
    draws = placed.groupBy("cell_id").agg(F.max("total").alias("total")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = draws.select("cell_id", (hash_uniform(seed, "cell_id", "draw") * F.col("total")).alias("at"), "draw",
                         F.lit(None).cast(one.schema["g"].dataType).alias("g"))
    line = Window.partitionBy("cell_id").orderBy("at", "draw").rowsBetween(Window.unboundedPreceding, 0)
    drawn = one.unionByName(draws).withColumn("g", F.last("g", ignorenulls=True).over(line)).where("draw > 0")
    order = Window.partitionBy("cell_id").orderBy(hash_int(f"{seed}c", "chromosome", "cell_id"), "chromosome", "start", "gene", "draw")
    return drawn.select("cell_id", "draw", "g.*").withColumn("pos", F.row_number().over(order) - 1)


def _sum(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x[field])


def _with_depth(rows, fields: tuple[str, ...], s: Column, t: Column) -> DataFrame:
    """Collect long rows to samples with the tokens [S] and [T] in front; s and t are per-cell columns of the rows."""
    body = collect_rows(rows.withColumns({"_s": s, "_t": t}), *fields, keep=("_s", "_t"))

    def head(gene, c):
        return F.struct(F.lit(gene).alias("gene"), *[F.col(c).alias(f) for f in fields])

    return body.select("cell_id", F.concat(F.array(head("[S]", "_s"), head("[T]", "_t")), "items").alias("items"))


def _log_factorial(n: Column) -> Column:
    """Stirling's series; its error is below 1e-13 from 200 on, where it is used."""
    return n * F.log(n) - n + F.log(n * 6.283185307179586) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)


def _inverse(ratio: Callable) -> Callable:
    """Number of values from ``low`` on whose distribution value is at most ``u``, plus ``low``, as a function of the columns first, low, high, u and more.

    Terms follow from ``first`` by ``ratio(k, more..)``; a row leaves the rounds when its draw is passed. The window from low to high leaves
    tails below the resolution of a draw. Rows with a null have null.
    """
    @F.pandas_udf(T.LongType())
    def run(columns: pd.DataFrame) -> pd.Series:
        out = pd.Series(pd.array([None] * len(columns), dtype="Int64"))
        here = columns.notna().all(axis=1).to_numpy()
        p, low, high, u, *more = columns[here].to_numpy(np.float64).T
        p, c, at, k = p.copy(), p.copy(), low.copy(), low + (p <= u)
        going = np.flatnonzero((c <= u) & (at < high))
        while len(going):
            at[going] += 1
            p[going] = p[going] * ratio(at[going], *[m[going] for m in more])
            c[going] += p[going]
            under = c[going] <= u[going]
            k[going] += under
            going = going[under & (at[going] < high[going])]
        out[here] = k.astype(np.int64)
        return out

    return lambda first, low, high, u, *more: run(F.struct(*[x.cast("double").alias(f"c{i}") for i, x in enumerate((first, low, high, u, *more))]))


_binomial_inverse = _inverse(lambda k, n, q: (n - k + 1) / k * q / (1 - q))
_poisson_inverse = _inverse(lambda k, rate: rate / k)


def _window(mean: Column, sd: Column) -> tuple[Column, Column]:
    """9 deviations around the mean; from 0 where the first term cannot underflow."""
    low = F.when(mean < 400, F.lit(0)).otherwise(F.floor(mean - 9 * sd - 24)).cast("bigint")
    return low, F.ceil(mean + 9 * sd + 24).cast("bigint")


def binomial(n: Column, p: Column, u: Column) -> Column:
    """Binomial(n, p) by inverse distribution of one uniform draw; the work grows with the deviation, not with n."""
    q, v = F.least(p, 1 - p), F.when(p <= 0.5, u).otherwise(1 - u)
    mean = n * q
    low, high = _window(mean, F.sqrt(mean * (1 - q)))
    at_low = _log_factorial(n) - _log_factorial(low) - _log_factorial(n - low) + low * F.log(q) + (n - low) * F.log(1 - q)
    first = F.when(low == 0, F.exp(n * F.log1p(-q))).otherwise(F.exp(at_low))
    drawn = F.least(n.cast("bigint"), _binomial_inverse(first, low, F.least(high, n.cast("bigint")), v, n, q))
    return F.when((n < 1) | (p <= 0), F.lit(0)).when(p >= 1, n).when(p <= 0.5, drawn).otherwise(n - drawn)


def beta_2_2(seed, *keys) -> Column:
    """Beta(2, 2): the middle one of three uniforms."""
    return F.sort_array(F.array(*[hash_uniform(f"{seed}b{i}", *keys) for i in range(3)]))[1]


def rda_downsample(samples, threshold: float | None, normalized_sum=10000.0, max_length: int | None = None, seed=0) -> DataFrame:
    """arr_rda_downsample (arr_rda_equal with threshold None): binomial thinning of deep cells with chance one half.

    Both versions are scaled to ``normalized_sum`` and log1p-ed; [S] and [T] hold log1p of the input and raw totals.
    """
    cell = Window.partitionBy("cell_id")
    rows = item_rows(samples if max_length is None else truncate(samples, max_length - 2))
    rows = rows.withColumnRenamed("value", "raw").withColumn("_raw", F.sum("raw").over(cell))
    if threshold is None:
        rows = rows.withColumn("inp", F.col("raw"))
    else:
        thin = (F.col("_raw") >= threshold) & (hash_uniform(f"{seed}g", "cell_id") < 0.5)
        rows = rows.withColumns({"_thin": thin, "_b": beta_2_2(seed, "cell_id")})
        # only thinned cells are drawn; others reach no round
        drawn = binomial(F.when(F.col("_thin"), F.col("raw")), F.col("_b"), hash_uniform(seed, "cell_id", "gene")).cast("double")
        rows = rows.withColumn("inp", F.when(F.col("_thin"), drawn).otherwise(F.col("raw")))
    rows = rows.withColumn("_in", F.sum("inp").over(cell))
    total = F.when(F.col("_raw") == 0, F.lit(1.0)).otherwise(F.col("_raw"))
    rows = rows.withColumn("_total", total).withColumns({
        "_used": F.when(F.col("_in") == 0, F.col("_total")).otherwise(F.col("_in")),
        "inp": F.when(F.col("_in") == 0, F.col("raw")).otherwise(F.col("inp")),
    })
    rows = rows.withColumns({
        "value": F.log1p(F.col("inp") / F.col("_used") * normalized_sum),
        "label": F.log1p(F.col("raw") / F.col("_total") * normalized_sum),
    })
    return _with_depth(rows, ("value", "label"), F.log1p("_used"), F.log1p("_total"))


def rda_equal(samples, normalized_sum=10000.0, max_length: int | None = None) -> DataFrame:
    """arr_rda_equal."""
    return rda_downsample(samples, None, normalized_sum, max_length)


def rda_align(samples, target: float, normalized_sum=10000.0, max_length: int | None = None) -> DataFrame:
    """arr_rda_align: [S] = log1p(total), [T] = log1p(target), values normalised and log1p-ed."""
    out = samples if max_length is None else truncate(samples, max_length - 2)
    out = out.withColumn("_t", _sum(F.col("items"), "value"))
    scaled = F.transform("items", lambda x: F.struct(
        x["gene"].alias("gene"), F.when(F.col("_t") > 0, F.log1p(x["value"] / F.col("_t") * normalized_sum)).otherwise(x["value"]).alias("value")))
    head = F.array(F.struct(F.lit("[S]").alias("gene"), F.log1p("_t").alias("value")),
                   F.struct(F.lit("[T]").alias("gene"), F.log1p(F.lit(float(target))).alias("value")))
    return out.select("cell_id", F.concat(head, scaled).alias("items"))


def poisson(rate: Column, u: Column) -> Column:
    """Poisson draw by inverse distribution of one uniform draw; terms start near the mean where that is large, so none underflows."""
    low, high = _window(rate, F.sqrt(rate))
    first = F.when(low == 0, F.exp(-rate)).otherwise(F.exp(low * F.log(rate) - rate - _log_factorial(low)))
    return _poisson_inverse(first, low, high, u, rate)


def poisson_downsample(samples, renoise: float = 0.6, max_length: int | None = None, log: bool = True, seed=0) -> DataFrame:
    """arr_poisson_downsample: x - Poisson(x r), masked with chance r, floored at zero; r = 0.55 renoise."""
    r = renoise * 0.55
    cell = Window.partitionBy("cell_id")
    rows = item_rows(samples if max_length is None else truncate(samples, max_length - 2))
    whole = F.when(F.col("value") % 1 != 0, F.raise_error(F.lit("raw counts are needed"))).otherwise(F.col("value"))
    rows = rows.withColumn("label", whole).withColumns({
        "_u": hash_uniform(f"{seed}p", "cell_id", "gene"), "_keep": (hash_uniform(f"{seed}m", "cell_id", "gene") >= r).cast("int"),
    }).withColumn("_t", F.sum("label").over(cell))
    noise = poisson(F.col("label") * r, F.col("_u"))
    rows = rows.withColumn("value", F.greatest(F.lit(0.0), (F.col("label") - noise) * F.col("_keep")))
    rows = rows.withColumnRenamed("_t", "_all").withColumn("_kept", F.sum("value").over(cell))
    if not log:
        return _with_depth(rows, ("value", "label"), F.col("_kept"), F.col("_all"))
    return _with_depth(rows.withColumn("value", F.log1p("value")), ("value", "label"), F.log1p("_kept"), F.log1p("_all"))


def pad_random(samples, n: int, seed=0) -> DataFrame:
    """arr_pad_random: all nonzero items, then random zeros up to n."""
    nonzero = F.filter("items", lambda x: x["value"] > 0)
    zeros = F.filter("items", lambda x: x["value"] <= 0)
    keyed = F.transform(zeros, lambda x: F.struct(hash_text(seed, F.col("cell_id"), x["gene"]).alias("k"), x["gene"].alias("g"), x.alias("x")))
    drawn = F.transform(F.sort_array(keyed), lambda s: s["x"])
    need = F.greatest(F.lit(0), F.lit(n) - F.size(nonzero))
    return samples.withColumn("items", F.concat(nonzero, F.slice(drawn, F.lit(1), need)))


def interleave_positions(pos: Column, size_a: Column, size_b: Column, is_a: Column, p: float, granularity: int = 10) -> Column:
    """arr_interleave: order key of item ``pos`` of list a or b when ka of a and kb of b alternate; leftovers a, then b."""
    if not 0 <= p <= 1:
        raise ValueError("p must be in [0, 1]")
    big = F.lit(1 << 40)
    if p == 0:
        return F.when(is_a, big + pos).otherwise(pos)
    if p == 1:
        return F.when(is_a, pos).otherwise(big + pos)
    ka, kb = max(1, int(p * granularity)), max(1, int((1 - p) * granularity))
    cycles = F.least(F.floor(size_a / ka), F.floor(size_b / kb))
    in_a, in_b = pos < cycles * ka, pos < cycles * kb
    key_a = F.when(in_a, F.floor(pos / ka) * (ka + kb) + pos % ka).otherwise(big + pos)
    key_b = F.when(in_b, F.floor(pos / kb) * (ka + kb) + ka + pos % kb).otherwise(2 * big + pos)
    return F.when(is_a, key_a).otherwise(key_b)


def pad_batchwise(rows, n: int, interleave: float | None = None, expressed_only: float | None = None, seed=0) -> DataFrame:
    """arr_pad_batchwise: own nonzeros, zeros expressed in the batch (shuffled), other zeros (shuffled), cut to n.

    ``rows`` is the dense long form (cell_id, batch_id, gene, pos, value). With ``interleave`` the first two
    are mixed at that ratio; with ``expressed_only`` a cell keeps only its nonzeros with that chance. A cell is ordered as one array; it
    meets the genes of its batch, not the batch's rows, so that rows that arrive dealt by cell are not exchanged again.
    """
    expressed = F.col("value") > 0
    # what a cell expresses is small and read twice; the dense rows themselves stay with their cell
    own = stable(rows.groupBy("cell_id", "batch_id").agg(F.collect_set(F.when(expressed, F.col("gene"))).alias("_own")))
    seen = own.select("batch_id", F.explode("_own").alias("gene")).groupBy("batch_id").agg(F.sort_array(F.collect_set("gene")).alias("_seen"))
    seen = seen.withColumn("_steps", halving_steps(F.col("_seen")))
    told = own.select("cell_id", "batch_id").join(seen, "batch_id").groupBy("cell_id").agg(F.collect_list(F.struct("batch_id", "_seen", "_steps")).alias("_told"))
    key = F.when(expressed, F.col("pos").cast("bigint")).otherwise(hash_int(seed, "cell_id", "gene"))
    items = rows.withColumn("_key", key).groupBy("cell_id").agg(F.collect_list(F.struct("_key", "gene", "batch_id", "value")).alias("_items"))
    unnamed = told.where("cell_id IS NULL").select("_told").scalar()  # rows without a cell are a cell, which a plain join would miss
    met = items.join(told, "cell_id", "left").withColumn("_told", F.when(F.col("cell_id").isNull(), unnamed).otherwise(F.col("_told")))

    def classed(x):
        of_batch = F.exists("_told", lambda t: (t["batch_id"] == x["batch_id"]) & in_sorted(t["_seen"], t["_steps"], x["gene"]))
        kind = F.when(x["value"] > 0, 0).when(of_batch, 1).otherwise(2)
        return F.struct(kind.alias("c"), x["_key"].alias("k"), x["gene"].alias("gene"), x["batch_id"].alias("batch_id"), x["value"].alias("value"))

    met = met.select("cell_id", F.sort_array(F.transform("_items", classed)).alias("_items"))
    if interleave is not None:
        met = met.withColumns({"_n0": F.size(F.filter("_items", lambda x: x["c"] == 0)), "_n1": F.size(F.filter("_items", lambda x: x["c"] == 1))})

        def placed(x, i):
            r = i.cast("bigint") - F.when(x["c"] == 0, 0).when(x["c"] == 1, F.col("_n0")).otherwise(F.col("_n0") + F.col("_n1"))
            mixed = interleave_positions(r, F.col("_n0"), F.col("_n1"), x["c"] == 0, interleave)
            return F.struct(F.when(x["c"] == 2, F.lit(1 << 45) + r).otherwise(mixed).alias("o"), x.alias("x"))

        met = met.withColumn("_items", F.transform(F.sort_array(F.transform("_items", placed)), lambda s: s["x"]))
    out = met.select("cell_id", F.posexplode(F.slice("_items", 1, max(n, 0))).alias("pos", "x"))
    if expressed_only is not None:
        out = out.where((hash_uniform(f"{seed}e", "cell_id") >= expressed_only) | (F.col("x.c") == 0))
    return out.select("cell_id", "x.batch_id", "pos", "x.gene", "x.value")


def add_datastore_field(rows, store, feature: str, out: str, log: bool = False) -> DataFrame:
    """arr_datastore_field: feature by (biosample, gene), missing = 0, optional log1p."""
    keyed = store.select("biosample_name", F.col("gene_symbol").alias("gene"), F.col(feature).cast("double").alias(out))
    value = F.coalesce(out, F.lit(0.0))
    return rows.join(keyed, ["biosample_name", "gene"], "left").withColumn(out, F.log1p(value) if log else value)


def log_normalize(samples, normalized_sum=10000.0, max_length: int | None = None) -> DataFrame:
    """nrm_log_sample in array form: log1p(x / (sum + 1) * s) after the cut."""
    out = samples if max_length is None else truncate(samples, max_length)
    out = out.withColumn("_t", _sum(F.col("items"), "value") + 1)
    return out.withColumn("items", F.transform("items", lambda x: F.struct(
        x["gene"].alias("gene"), F.log1p(x["value"] / F.col("_t") * normalized_sum).alias("value")))).drop("_t")


def downcast_items(samples) -> DataFrame:
    return samples.withColumn("items", F.transform("items", lambda x: F.struct(
        x["gene"].alias("gene"), F.bround(x["value"], 0).cast("bigint").alias("value"))))


def compose(samples, medians=None, tokens=None, drop_weights=None, drop_fraction: float | None = None, sequence_order: str | None = None,
            max_length: int | None = None, normalize: bool = False, depth: str | int | None = None, round_values: bool = False,
            orthologs=None, seed=0) -> DataFrame:
    """arr_compose: the configured transforms in their fixed order; a depth transform switches plain log-normalise off."""
    out = samples
    if medians is not None:
        rows = item_rows(out).join(medians.select("gene", "median"), "gene")
        out = collect_rows(rows.withColumn("value", F.col("value") / F.col("median")), "value")
    if tokens is not None:
        out = limit_tokens(out, tokens)
    if drop_weights is not None:
        out = dropout_selective(out, drop_weights, drop_fraction, seed)
    if sequence_order == "random":
        out = shuffle(out, seed)
    elif sequence_order == "sorted":
        out = sort_by_value(out)
    if max_length is not None:
        out = truncate(out, max_length)
    if drop_fraction is not None and drop_weights is None:
        out = dropout_chunk(out, int(drop_fraction), 0, max_length - 1, seed) if drop_fraction > 1 else dropout(out, drop_fraction, seed)
    if normalize and depth is None:
        out = log_normalize(out, max_length=max_length)
    if depth == "downsample":
        out = rda_downsample(out, 1000.0, max_length=max_length, seed=seed)
    elif depth == "poisson_downsample":
        out = poisson_downsample(out, max_length=max_length, seed=seed)
    elif depth == "equal":
        out = rda_equal(out, max_length=max_length)
    elif isinstance(depth, int):
        out = rda_align(out, depth, max_length=max_length)
    if round_values:
        out = downcast_items(out)
    return out if orthologs is None else remap(out, orthologs)

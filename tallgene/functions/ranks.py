"""Exact ranks and quantiles that never put a whole group into one task.

A plain ``row_number() over (partition by label)`` sends one label to one task, and a global
``percentile`` merges every distinct value in one task. Here a group is first cut into many
buckets (of the value range, or of the row hash); bucket totals are tiny, their running sum
gives each bucket its offset, and only rows of one bucket meet in a task. How many buckets a group
has follows from its own size; small groups are one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.lineage import stable
from tallgene.functions.rand import BITS, hash_int

#: Distinct values of a bucket that need no further cut; buckets wanted for so many values of a larger one.
BOUND, CUTS = 1 << 16, 4
#: Leading bits of the hash that tell in which range of it a row is.
HASH_SHIFT = BITS - 12


def meet(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null, so that rows without a group are a group of their own."""
    other = right.withColumnsRenamed({c: f"_meet_{c}" for c in by})
    same = [left[c].eqNullSafe(other[f"_meet_{c}"]) for c in by]
    return left.join(other, same, how).drop(*[f"_meet_{c}" for c in by])


def _over(by: Sequence[str], *order) -> Window:
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return w.orderBy(*order)


def hash_ranks(df: DataFrame, by: Sequence[str], seed, keys: Sequence[str], out: str = "rn", total: str | None = None, upto: int | None = None) -> DataFrame:
    """Number the rows of each group 1..n in hash order (ties by ``keys``); optionally with the group size, or only the first ``upto``.

    Two passes over ``df``, one of them on the key columns only; a hot group is spread over 4096 ranges of the hash. The histogram of the ranges
    tells which of them can hold a number up to ``upto``, and only their rows are shuffled and ranked. Key columns must identify
    a row; rows whose group is null are a group.
    """
    by = list(by)
    rows = df.withColumn("_h", hash_int(seed, *keys)).withColumn("_hb", F.shiftright("_h", HASH_SHIFT))
    sizes = rows.groupBy(*by, "_hb").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *by, "_hb",
        F.coalesce(F.sum("_n").over(_over(by, "_hb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        *([F.sum("_n").over(Window.partitionBy(*by)).alias(total)] if total else []),
    )
    inner = Window.partitionBy(*by, "_hb").orderBy("_h", *keys)
    if upto is not None:
        offsets = offsets.where(F.col("_off") < upto)
    ranked = meet(rows, offsets, [*by, "_hb"]).withColumn(out, F.row_number().over(inner) + F.col("_off"))
    return (ranked if upto is None else ranked.where(F.col(out) <= upto)).drop("_h", "_hb", "_off")


def ordered_key(value: Column) -> Column:
    """A 62-bit integer that does not fall where the value grows: exponent and leading bits of the fraction, below 0 for negative values."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << 50))
    key = (exponent + 1076) * (1 << 50) + F.greatest(F.lit(0), F.least(F.lit((1 << 50) - 1), part))
    most = 2200 * (1 << 50)
    inside = F.when(value == 0, F.lit(0)).when(value < 0, -key).otherwise(key)
    return F.when(F.isnan(value) | (value == float("inf")), F.lit(most)).when(value == float("-inf"), F.lit(-most)).otherwise(inside)


def _number(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType.typeName()
    return (F.unix_date(col) if kind == "date" else F.col(col)).cast("double")


def _cut(df: DataFrame, by: list[str], out: str, small: Column | None = None) -> DataFrame:
    """``df`` (by, _key, ..) with a bucket ``out`` of the key: 0 in groups of at most BOUND rows, else about one of CUTS * rows / BOUND equal parts of
    the group's own range of keys. Only groups above BOUND (and not ``small``) have an entry to meet."""
    rows = df if small is None else df.where(~small)
    # counts of all columns, so that none is pruned and every branch shares the exchange that made ``df``
    held = reduce(lambda a, b: a | b, [F.col("n") > 0, *[F.col(c).isNull() for c in df.columns if c not in by]])
    large = rows.groupBy(*by).agg(F.count_if(held).alias("_d"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi")).where(F.col("_d") > BOUND)
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_d") * CUTS / BOUND)))
    cut = F.coalesce(F.floor((F.col("_key") - F.col("_lo")) / width), F.lit(0)).cast("long")
    if by:
        met = meet(df, large, by, "left")
    else:
        one = large.select(F.struct("_lo", "_hi", "_d").alias("s")).scalar()
        met = df.withColumns({c: one[c] for c in ("_lo", "_hi", "_d")})
    return met.withColumns({out: cut, f"{out}_cut": F.col("_d").isNotNull()}).drop("_lo", "_hi", "_d")


def value_ranks(df: DataFrame, by: Sequence[str], col: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct (group, value): ``n`` rows, ``n_before`` rows with a smaller value, ``n_total``.

    Values are pre-aggregated map-side, so repeated values (counts) collapse before any sort. Every column named in ``sums`` is summed per
    value and gets the same ``_before`` running total. Groups with more than BOUND distinct values are cut by a key that follows the order of
    the values, and what still holds more is cut once more by its own range, so that depth and number of buckets follow the data. The plan
    is the same at every size; its branches share the one exchange of distinct values, and groups that need no cut join empty tables.
    """
    by = list(by)
    sums = sums or {}
    parts = ["n", *sums]
    freq = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    freq = freq.withColumn("_key", ordered_key(_number(freq, col)))
    cut = _cut(_cut(freq, by, "_b"), [*by, "_b"], "_c", ~F.col("_b_cut"))
    buckets = cut.where("_b_cut").groupBy(*by, "_b", "_c").agg(*[F.sum(k).alias(f"_b_{k}") for k in parts])
    earlier = _over(by, "_b", "_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(*by, "_b", "_c", *[F.coalesce(F.sum(f"_b_{k}").over(earlier), F.lit(0)).alias(f"_off_{k}") for k in parts])
    inner = Window.partitionBy(*by, "_b", "_c").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, "_b", "_c")
    totals = buckets.groupBy(*by).agg(F.sum("_b_n").alias("_all"))
    met = meet(cut, offsets, [*by, "_b", "_c"], "left")
    met = meet(met, totals, by, "left") if by else met.withColumn("_all", totals.select("_all").scalar())
    return met.withColumns({
        **{f"{k}_before": F.coalesce(F.sum(k).over(inner), F.lit(0)) + F.coalesce(f"_off_{k}", F.lit(0)) for k in parts},
        "n_total": F.coalesce("_all", F.sum("n").over(whole)),
    }).select(*by, col, *parts, "n_total", *[f"{k}_before" for k in parts])


def quantiles(df: DataFrame, by: Sequence[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per name in ``probs``."""
    by = list(by)
    ranks = value_ranks(df, by, col)
    n = F.col("n_total") - 1
    picks = []
    for name, p in probs.items():
        pos = n * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(col))).alias(f"_{name}_{side}"))
    agg = ranks.groupBy(*by).agg(F.max("n_total").alias("_n"), *picks)
    cols = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return agg.select(*by, *cols)


def global_quantiles(df: DataFrame, col: str, probs: dict[str, float]) -> dict[str, Column]:
    """Global quantiles as scalar subqueries on one written row, usable inside any expression."""
    one = stable(quantiles(df, [], col, probs).select(F.struct(*probs).alias("q"))).scalar()
    return {name: one.getField(name) for name in probs}


def quantiles_of_columns(df: DataFrame, cols: Sequence[str], probs: dict[str, float]) -> dict[str, dict[str, Column]]:
    """Global quantiles of several columns from one pass; ``result[col][name]`` is a scalar subquery."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in cols
    ])).alias("m")).select("m.*")
    table = stable(quantiles(long, ["metric"], "x", probs))
    lookup = table.select(F.map_from_entries(F.collect_list(F.struct("metric", F.struct(*probs))))).scalar()
    return {c: {name: lookup.getItem(c).getField(name) for name in probs} for c in cols}


def take_by_hash(df: DataFrame, n: int, seed, keys: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows, chosen by hash order, without sorting the table."""
    return hash_ranks(df, [], seed, keys, "_rn", upto=n).drop("_rn")

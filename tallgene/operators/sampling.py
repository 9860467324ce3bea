"""Splits and samples from hashed row keys (survey section 2.8).

Every choice is ``hash(seed, key)``: independent of partitions, repeatable after task loss. Choices
inside a group use bucketed ranks, so a group may hold a third of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.rand import hash_int, hash_uniform
from tallgene.functions.ranks import hash_ranks, take_by_hash

CONTROL = "Control"


def by_weights(u: Column, weights: dict[str, float]) -> Column:
    """Name of the split whose slice of [0, 1) holds ``u``."""
    names = list(weights)
    edges = [sum(list(weights.values())[: i + 1]) for i in range(len(names))]
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))[:-1]):
        out = F.when(u < edge, F.lit(name)).otherwise(out)
    return out


def random_split(df, weights: dict[str, float], keys: list[str], seed=42) -> DataFrame:
    """spl_random: split per row."""
    return df.withColumn("split", by_weights(hash_uniform(seed, *keys), weights))


def stratified_split(df, label: str, weights: dict[str, float], keys: list[str], seed=42) -> DataFrame:
    """spl_stratified: exact shares in every label; test first, then dev out of the rest."""
    ranked = hash_ranks(df, [label], seed, keys, "_rn", total="_n")
    n_test = F.round(F.col("_n") * weights["test"])
    n_dev = F.round((F.col("_n") - n_test) * (weights["dev"] / (weights["train"] + weights["dev"])))
    split = F.when(F.col("_rn") <= n_test, "test").when(F.col("_rn") <= n_test + n_dev, "dev").otherwise("train")
    return ranked.withColumn("split", split).drop("_rn", "_n")


# splits of perturbation names: tables of distinct names, bounded by the design of the experiment ----

def _names(obs, col):
    return obs.select(F.col(col).alias("p")).where(F.col("p") != CONTROL).distinct().withColumn("combo", F.col("p").contains("_"))


def _take(df, share, seed, flag: str, at_least_one: bool) -> DataFrame:
    """Mark ``int(n * share)`` names (at least one if asked) in hash order."""
    w = Window.orderBy(hash_int(seed, "p"), "p")
    n = F.floor(F.count("*").over(Window.partitionBy()) * F.lit(share))
    n = F.greatest(n, F.lit(1)) if at_least_one else n
    return df.withColumn(flag, F.row_number().over(w) <= n)


def split_single(names, weights, seed) -> DataFrame:
    """Single names: test, then dev out of the rest, the rest train."""
    tested = _take(names.where(~F.col("combo")), weights["test"], f"{seed}t", "t", True)
    rest = _take(tested.where(~F.col("t")), weights["dev"], f"{seed}d", "d", True)
    return tested.where("t").select("p", F.lit("test").alias("split")).unionByName(
        rest.select("p", F.when(F.col("d"), "dev").otherwise("train").alias("split")))


def _attach(obs, col, split) -> DataFrame:
    out = obs.join(split.withColumnRenamed("p", col), col, "left")
    return out.withColumn("split", F.when(F.col(col) == CONTROL, "train").otherwise(F.col("split")))


def split_single_only(obs, weights, seed=42, col="perturbation") -> DataFrame:
    """spl_pert_single_only: single perturbations without overlap; combinations get no split."""
    return _attach(obs, col, split_single(_names(obs, col), weights, seed))


def split_single_and_combos(obs, weights, seed=42, col="perturbation") -> DataFrame:
    """spl_pert_single: test singles first; other names train unless a part is a test gene; dev comes out of train."""
    names = _names(obs, col)
    tested = _take(names.where(~F.col("combo")), weights["test"], f"{seed}t", "t", True).where("t").select("p")
    hit = (
        names.where("combo").select("p", F.explode(F.split("p", "_")).alias("g"))
        .join(tested.select(F.col("p").alias("g")), "g", "left_semi").select("p")
    )
    train = names.join(tested, "p", "left_anti").join(hit, "p", "left_anti")
    singles = _take(train.where(~F.col("combo")), weights["dev"], f"{seed}d", "d", True)
    dev = singles.where("d").select("p")
    dev_hit = (
        train.where("combo").select("p", F.explode(F.split("p", "_")).alias("g"))
        .join(dev.select(F.col("p").alias("g")), "g", "left_semi").select("p")
    )
    kept = train.join(dev, "p", "left_anti").join(dev_hit, "p", "left_anti")
    split = tested.select("p", F.lit("test").alias("split")).unionByName(dev.select("p", F.lit("dev").alias("split"))).unionByName(
        kept.select("p", F.lit("train").alias("split")))
    return _attach(obs, col, split)


def combos_with_seen(names, singles) -> DataFrame:
    """Combination names with the number of parts among the train singles."""
    train = singles.where("split = 'train'").select(F.col("p").alias("g"), F.lit(1).alias("hit"))
    parts = names.where("combo").select("p", F.explode(F.split("p", "_")).alias("g"))
    return parts.join(train, "g", "left").groupBy("p").agg(F.count("hit").alias("seen"))


def split_combo_seen(obs, weights, seen: int, seed=42, col="perturbation") -> DataFrame:
    """spl_pert_combo_seen: combinations with exactly ``seen`` train parts partly go to test, then dev."""
    names = _names(obs, col)
    singles = split_single(names, weights, seed)
    combos = combos_with_seen(names, singles)
    tested = _take(combos.where(F.col("seen") == seen), weights["test"], f"{seed}ct", "t", True)
    rest = _take(tested.where(~F.col("t")), weights["dev"], f"{seed}cd", "d", True)
    moved = tested.where("t").select("p", F.lit("test").alias("split")).unionByName(
        rest.where("d").select("p", F.lit("dev").alias("split")))
    others = combos.join(moved, "p", "left_anti").select("p", F.lit("train").alias("split"))
    return _attach(obs, col, singles.unionByName(moved).unionByName(others))


def split_simulation(obs, weights, seed=42, seen2_train=0.85, col="perturbation") -> DataFrame:
    """spl_pert_simulation: strata by seen parts; 85% of seen2 train, the others half dev, half test; with group names."""
    names = _names(obs, col)
    singles = split_single(names, weights, seed)
    combos = combos_with_seen(names, singles)
    two = _take(combos.where("seen = 2"), seen2_train, f"{seed}s2", "t", False)
    out = singles.select("p", "split", F.when(F.col("split") != "train", F.concat(F.lit("unseen_single_"), "split")).alias("group"))
    out = out.unionByName(two.where("t").select("p", F.lit("train").alias("split"), F.lit(None).cast("string").alias("group")))
    for k, part in ((0, combos.where("seen = 0")), (1, combos.where("seen = 1")), (2, two.where("not t"))):
        half = _take(part.select("p"), 0.5, f"{seed}h{k}", "t", False)
        split = F.when(F.col("t"), "test").otherwise("dev")
        out = out.unionByName(half.select("p", split.alias("split"), F.concat(F.lit(f"combo_seen{k}_"), split).alias("group")))
    return _attach(obs, col, out)


def split_by_coverage(obs, dataset="dataset", label="cell_type") -> DataFrame:
    """spl_by_dataset_coverage: greedy over datasets, fewest types and cells first; dev if its types are
    known to train but not all to dev.

    The distributed part reduces all cells to one row per dataset; the greedy pass folds over that
    short ordered list (datasets, a few hundred) inside one expression.
    """
    counts = obs.groupBy(dataset, label).agg(F.count("*").alias("n"))
    types = counts.groupBy(dataset).agg(F.sort_array(F.collect_set(label)).alias("types"), F.sum("n").alias("n"))
    entry = F.struct(F.size("types").alias("k"), "n", F.col(dataset).alias("d"), "types")
    lst = types.agg(F.array_sort(F.collect_list(entry)).alias("l"))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("train"), empty.alias("dev"),
                     F.array().cast("array<struct<d:string,split:string>>").alias("out"))

    def step(acc, x):
        known = F.size(F.array_except(x["types"], acc["train"])) == 0
        covered = F.size(F.array_except(x["types"], acc["dev"])) == 0
        to_dev = known & ~covered
        row = F.struct(x["d"].cast("string").alias("d"), F.when(to_dev, "dev").otherwise("train").alias("split"))
        return F.struct(
            F.when(to_dev, acc["train"]).otherwise(F.array_union(acc["train"], x["types"])).alias("train"),
            F.when(to_dev, F.array_union(acc["dev"], x["types"])).otherwise(acc["dev"]).alias("dev"),
            F.concat(acc["out"], F.array(row)).alias("out"),
        )

    folded = lst.select(F.explode(F.aggregate("l", start, step)["out"]).alias("o"))
    return folded.select(F.col("o.d").alias(dataset), "o.split")


def split_by_fold(df, fold="fold") -> DataFrame:
    """spl_by_fold: folds 0-5 train, 6-7 dev, 8-9 test."""
    f = F.col(fold)
    return df.withColumn("split", F.when(f.between(0, 5), "train").when(f.between(6, 7), "dev").when(f.between(8, 9), "test"))


def split_positional(df, order: str, share: float = 0.9) -> DataFrame:
    """spl_positional: first part of the rows by position is train, the rest dev."""
    from tallgene.functions.ranks import value_ranks

    ranks = value_ranks(df, [], order).select(order, "n_before", "n_total")
    return df.join(ranks, order).withColumn(
        "split", F.when(F.col("n_before") < F.floor(F.col("n_total") * F.lit(share)), "train").otherwise("dev")
    ).drop("n_before", "n_total")


def shuffle_blocks(df, row: str, block: int, weights: dict[str, float], seed=42) -> DataFrame:
    """spl_shuffle_blocks: rows numbered by ``row`` (0..); each block is shuffled and cut by ratios."""
    rows = df.withColumn("block", F.floor(F.col(row) / block))
    w = Window.partitionBy("block").orderBy(hash_int(seed, row), row)
    ranked = rows.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("block"))})
    a = F.floor(F.col("_n") * weights["train"])
    b = a + F.floor(F.col("_n") * weights["dev"])
    split = F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "dev").otherwise("test")
    return ranked.withColumn("split", split).drop("_r", "_n")


def split_studies(obs, study: str, weights: dict[str, float], seed=42, drop: str = "notused") -> DataFrame:
    """spl_study: shuffle studies and cut by count; rows of the unused study drop out."""
    rows = obs.where(F.col(study) != drop)
    names = rows.select(study).distinct()
    w = Window.orderBy(hash_int(seed, study), study)
    n = F.count("*").over(Window.partitionBy())
    r = F.row_number().over(w)
    split = F.when(r <= F.floor(n * weights["train"]), "train").when(
        r <= F.floor(n * (weights["train"] + weights["dev"])), "dev").otherwise("test")
    return rows.join(names.withColumn("split", split), study)


def split_cross_source(obs, source: str, test_sources: list, keys: list[str], dev_share=0.1, seed=42) -> DataFrame:
    """spl_source_cross: listed sources test; the other rows 9:1 train and dev."""
    u = hash_uniform(seed, *keys)
    return obs.withColumn("split", F.when(F.col(source).isin(*test_sources), "test").when(u < dev_share, "dev").otherwise("train"))


def split_from_map(obs, mapping, gene: str) -> DataFrame:
    """spl_from_map: gene -> split table, ``val`` renamed dev, unmapped null."""
    joined = obs.join(mapping.select(gene, F.col("split").alias("_s")), gene, "left")
    return joined.withColumn("split", F.when(F.col("_s") == "val", "dev").otherwise(F.col("_s"))).drop("_s")


def split_from_parts(parts: dict[str, DataFrame], control: Column, rename: dict[str, str]) -> DataFrame:
    """Parts one after the other with ``split``, a part's name, and ``split_for_test``, the same under the names of ``rename``.

    Controls serve every split, so those of a part after the first belong to none: both columns are null. A null ``control`` is no control.
    Columns that a part lacks are null there; repeated rows stay rows.
    """
    def marked(i: int, name: str) -> Column:
        return F.lit(name) if i == 0 else F.when(~F.coalesce(control, F.lit(False)), F.lit(name))

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("split", marked(i, name)) for i, (name, df) in enumerate(parts.items())])
    other = reduce(lambda acc, kv: F.when(F.col("split") == kv[0], F.lit(kv[1])).otherwise(acc), rename.items(), F.col("split"))
    return rows.withColumn("split_for_test", other)


def disjoint_check(obs, rename, col="perturbation") -> DataFrame:
    """spl_disjoint_check: names found in more than one split, before and after renaming, per pair of splits."""
    both = F.explode(F.array(F.struct(F.lit("before").alias("stage"), F.col(col).alias("p")),
                             F.struct(F.lit("after").alias("stage"), rename(F.col(col)).alias("p"))))
    uniq = obs.select("split", both.alias("b")).select("split", "b.stage", "b.p").distinct()
    sets = uniq.groupBy("stage", "p").agg(F.sort_array(F.collect_set("split")).alias("s"))
    # at most three splits, so at most three pairs per name
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.concat_ws("&", a, b))))
    return sets.select("stage", F.explode(pairs).alias("pair")).groupBy("stage", "pair").agg(F.count("*").alias("n_shared"))


def share_check(obs, weights: dict[str, float], tolerance: float) -> DataFrame:
    """spl_share_check: realised share of every split against the wanted one."""
    total = obs.select(F.count("*")).scalar()
    want = reduce(lambda acc, kv: F.when(F.col("split") == kv[0], F.lit(kv[1])).otherwise(acc), weights.items(), F.lit(None).cast("double"))
    out = obs.groupBy("split").agg(F.count("*").alias("n")).withColumns({"share": F.col("n") / total, "wanted": want})
    return out.withColumn("ok", F.abs(F.col("share") - F.col("wanted")) <= tolerance)


# samples ---------------------------------------------------------------------------------------------

def sample_n(df, n: int, keys: list[str], seed=42) -> DataFrame:
    """smp_n: exactly n random rows."""
    return take_by_hash(df, n, seed, keys)


def sample_n_per_group(df, n: int, group: str, keys: list[str], seed=42) -> DataFrame:
    """smp_n_per_group: exactly n per group, smaller groups dropped."""
    return hash_ranks(df, [group], seed, keys, "_rn", total="_n", upto=n).where(F.col("_n") >= n).drop("_rn", "_n")


def sample_upto_n_per_group(df, n: int, group: str, keys: list[str], seed=42) -> DataFrame:
    """smp_upto_n_per_group."""
    return hash_ranks(df, [group], seed, keys, "_rn", upto=n).drop("_rn")


def sample_fraction(df, fraction: float, keys: list[str], seed=42) -> DataFrame:
    """smp_fraction."""
    return df.where(hash_uniform(seed, *keys) < fraction)


def equal_quotas(df, group: str, total: Column | None = None, fraction: float | None = None) -> DataFrame:
    """Quota per group: the water level L with sum(min(size, L)) = total; the remainder goes to the largest groups.

    Runs on one row per group.
    """
    up = Window.orderBy("size", group)
    every = Window.partitionBy()
    wanted = total if fraction is None else F.floor(F.sum("size").over(every) * F.lit(fraction))
    sizes = df.groupBy(group).agg(F.count("*").alias("size")).withColumn("total", wanted)
    s = sizes.withColumns({
        "below": F.coalesce(F.sum("size").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "left": F.count("*").over(every) - F.row_number().over(up) + 1,
    })
    # a group is kept whole while an equal share of what is left covers it
    s = s.withColumn("whole", F.col("size") * F.col("left") <= F.col("total") - F.col("below"))
    s = s.withColumns({
        "used": F.sum(F.when(F.col("whole"), F.col("size")).otherwise(0)).over(every),
        "open": F.count_if(~F.col("whole")).over(every),
    })
    level = F.floor((F.col("total") - F.col("used")) / F.col("open"))
    rest = F.col("total") - F.col("used") - level * F.col("open")
    place = F.row_number().over(Window.orderBy("whole", F.col("size").desc(), group))
    quota = F.when(F.col("whole"), F.col("size")).otherwise(level + (place <= rest).cast("int"))
    return s.select(group, "size", quota.cast("bigint").alias("quota"))


def sample_equal_quota(df, group: str, fraction: float, keys: list[str], seed=42) -> DataFrame:
    """smp_equal_quota: small groups keep all, the others share equally; exact total."""
    quotas = equal_quotas(df, group, fraction=fraction).select(group, "quota")
    return hash_ranks(df, [group], seed, keys, "_rn").join(quotas, group).where(F.col("_rn") <= F.col("quota")).drop("_rn", "quota")


def balanced_weights(df, label: str) -> DataFrame:
    """Row weight 1 / size of its label."""
    sizes = df.groupBy(label).agg((1 / F.count("*")).alias("weight"))
    return df.join(sizes, label)


def sample_balanced(df, label: str, n: int, keys: list[str], seed=42) -> DataFrame:
    """smp_balanced_weights: n draws with replacement, label uniform, then a row uniform in the label.

    Draws meet rows by an equi join on (label, position), no range join; draws are made in Spark.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    labels = sizes.withColumn("_l", F.row_number().over(Window.orderBy(label)) - 1)
    k = labels.select(F.count("*")).scalar()
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    draws = draws.withColumn("_l", F.floor(hash_uniform(f"{seed}l", "draw") * k).cast("int")).join(labels, "_l")
    draws = draws.withColumn("_rn", F.floor(hash_uniform(f"{seed}r", "draw") * F.col("_n")) + 1).select(label, "draw", "_rn")
    return hash_ranks(df, [label], seed, keys, "_rn").join(draws, [label, "_rn"]).drop("_rn")


def poisson_one(u: Column, most: int = 18) -> Column:
    """Poisson(1) by inverse distribution of a uniform draw; more than ``most`` is rarer than a draw can tell."""
    p = q = 0.36787944117144233
    out = F.lit(0)
    for k in range(1, most + 1):
        out = out + (u >= F.lit(q)).cast("int")
        p = p / k
        q = q + p
    return out


def bootstrap(df, runs: int, seed=42, keys: list[str] = ("cell_id",)) -> DataFrame:
    """smp_bootstrap: every row appears Poisson(1) times in every run, so a run has n rows on average."""
    out = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    times = poisson_one(hash_uniform(seed, "run", *keys))
    return out.withColumn("_t", times).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t")


def weighted_mix(sources: dict[str, DataFrame], weights: dict[str, float] | None, keys: list[str], seed=42) -> DataFrame:
    """smp_weighted_mix: rows of each source kept at rate weight / largest weight; without weights, all rows."""
    top = max(weights.values()) if weights else 1.0
    out = None
    for name, df in sources.items():
        rate = weights[name] / top if weights else 1.0
        part = df.where(hash_uniform(f"{seed}{name}", *keys) < rate) if rate < 1 else df
        part = part.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sparsify(expr, drop: float, seed=42) -> DataFrame:
    """smp_sparsify: drop nonzero entries with a probability, every cell keeps at least one."""
    drawn = expr.withColumn("_u", hash_uniform(seed, "cell_id", "gene"))
    best = Window.partitionBy("cell_id").orderBy(F.desc("_u"), "gene")
    ranked = drawn.withColumn("_r", F.row_number().over(best))
    return ranked.where((F.col("_u") >= drop) | (F.col("_r") == 1)).drop("_u", "_r")


def grid_subset(expr, obs, n_perturbations: int, n_genes: int, col="perturbation") -> tuple[DataFrame, DataFrame]:
    """smp_grid_subset: first k perturbations and Control, first m genes (by name)."""
    perts = obs.select(col).where(F.col(col) != CONTROL).distinct().orderBy(col).limit(n_perturbations)
    keep = perts.unionByName(obs.select(col).where(F.col(col) == CONTROL).distinct())
    cells = obs.join(keep, col, "left_semi")
    genes = expr.select("gene").distinct().orderBy("gene").limit(n_genes)
    return expr.join(genes, "gene", "left_semi").join(cells.select("cell_id"), "cell_id", "left_semi"), cells


def interleave_order(obs, keys: list[str], seed=42, col="perturbation", split="split") -> DataFrame:
    """smp_interleave_order: position with controls first in random order, then every split shuffled."""
    part = F.when(F.col(col) == CONTROL, F.lit("")).otherwise(F.col(split))
    tagged = obs.withColumn("_part", part)
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    offs = sizes.select("_part", F.coalesce(
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return hash_ranks(tagged, ["_part"], seed, keys, "_rn").join(offs, "_part").withColumn(
        "position", F.col("_off") + F.col("_rn") - 1).drop("_part", "_rn", "_off")

"""Set operations, concatenation and vocabularies (survey section 2.7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.ranks import value_ranks

CONTROL = "Control"
# Special tokens that lead every vocabulary field, in order.
SPECIAL_TOKENS = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")


def _tagged(parts: dict[str, DataFrame], label: str) -> DataFrame:
    rows = [df.withColumn(label, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def concat_outer(parts: dict[str, DataFrame], label: str = "batch") -> DataFrame:
    """set_concat_outer: union with a source label; missing genes are implicit zeros of the long form."""
    return _tagged(parts, label)


def common_genes(parts: dict[str, DataFrame]) -> DataFrame:
    """Genes that occur in every part, from one grouping of all parts."""
    listed = _tagged({name: df.select("gene") for name, df in parts.items()}, "_part")
    return listed.groupBy("gene").agg(F.count_distinct("_part").alias("_n")).where(F.col("_n") == len(parts)).select("gene")


def concat_inner(parts: dict[str, DataFrame], label: str = "batch") -> DataFrame:
    """set_concat_inner: union restricted to genes present in every part.

    Rows stream past a hash table of their share of the genes, so they are not sorted.
    """
    return _tagged(parts, label).join(common_genes(parts).hint("shuffle_hash"), "gene", "left_semi")


def unique_cells(obs, prefix: str, id_col: str, order: str, out: str = "cell_name") -> DataFrame:
    """set_unique_cells: prefix_id as name; repeats get a numbered suffix in the order of a unique column.

    The number is the bucketed rank of the order column, so a name may repeat very often.
    """
    named = obs.withColumn(out, F.concat_ws("_", prefix, F.col(id_col).cast("string")))
    ranks = value_ranks(named, [out], order).select(out, order, F.col("n_before").alias("_k"))
    suffixed = F.concat_ws("-", out, F.col("_k").cast("string"))
    return named.join(ranks, [out, order]).withColumn(out, F.when(F.col("_k") == 0, F.col(out)).otherwise(suffixed)).drop("_k")


def vocab_union(parts: list[DataFrame]) -> DataFrame:
    """set_vocab_union: sorted union of gene names with a position (bounded by the gene universe)."""
    names = reduce(lambda a, b: a.unionByName(b), [p.select("gene") for p in parts]).distinct()
    return names.withColumn("pos", F.row_number().over(Window.orderBy("gene")) - 1)


def build_vocabulary(genes, expression_bins: int) -> DataFrame:
    """set_vocab_build: special tokens, then tokens, per field; local ids in the field and global ids over fields."""
    spark = genes.sparkSession

    def special(field, n):
        items = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("token")) for i, t in enumerate(SPECIAL_TOKENS)])
        return spark.range(1).select(F.explode(items).alias("s")).select(
            F.lit(n).alias("fno"), F.lit(field).alias("field"), F.lit(0).alias("prio"), F.col("s.i").cast("bigint").alias("pos"), "s.token")

    gene_rows = genes.select(F.lit(0).alias("fno"), F.lit("genes").alias("field"), F.lit(1).alias("prio"),
                             F.col("pos").cast("bigint").alias("pos"), F.col("gene").alias("token"))
    bins = spark.range(expression_bins).select(F.lit(1).alias("fno"), F.lit("expressions").alias("field"), F.lit(1).alias("prio"),
                                               F.col("id").alias("pos"), F.col("id").cast("string").alias("token"))
    rows = reduce(lambda a, b: a.unionByName(b), [special("genes", 0), gene_rows, special("expressions", 1), bins])
    return number_tokens(rows)


def number_tokens(rows) -> DataFrame:
    order = ["prio", "pos"]
    return rows.select(
        "field", "token",
        (F.row_number().over(Window.partitionBy("field").orderBy(*order)) - 1).alias("local_id"),
        (F.row_number().over(Window.orderBy("fno", *order)) - 1).alias("global_id"),
    )


def subset_vocabulary(vocab, genes) -> DataFrame:
    """set_vocab_subset: keep special tokens, other fields and listed genes; renumber."""
    keep = vocab.where((F.col("field") != "genes") | F.col("token").isin(*SPECIAL_TOKENS))
    listed = vocab.where(F.col("field") == "genes").join(genes.select(F.col("gene").alias("token")), "token", "left_semi")
    both = keep.select("field", "token", "global_id").unionByName(listed.select("field", "token", "global_id")).distinct()
    return both.select(
        "field", "token",
        (F.row_number().over(Window.partitionBy("field").orderBy("global_id")) - 1).alias("local_id"),
        (F.row_number().over(Window.orderBy("global_id")) - 1).alias("global_id"))


def overlap_counts(a, b, key: str) -> DataFrame:
    """set_overlap_counts: sizes, union, intersection and both differences."""
    both = a.select(key, F.lit(1).alias("m")).unionByName(b.select(key, F.lit(2).alias("m"))).groupBy(key).agg(F.bit_or("m").alias("m"))
    m = F.col("m")
    return both.agg(
        F.count_if(m != 2).alias("n_a"), F.count_if(m != 1).alias("n_b"), F.count("*").alias("n_union"),
        F.count_if(m == 3).alias("n_both"), F.count_if(m == 1).alias("a_only"), F.count_if(m == 2).alias("b_only"))


def membership_patterns(parts: dict[str, DataFrame], key: str, min_size: int = 1) -> DataFrame:
    """set_membership_patterns: number of members for every combination of sources."""
    rows = reduce(lambda x, y: x.unionByName(y), [df.select(key, F.lit(n).alias("source")) for n, df in parts.items()])
    pats = rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("source")), "&").alias("pattern"))
    return pats.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)


def prefix_counts(a, b, key: str, width: int = 4) -> DataFrame:
    """set_prefix_counts: names in a but not in b, counted by their first characters."""
    only = a.select(key).distinct().join(b.select(key), key, "left_anti")
    return only.groupBy(F.substring(key, 1, width).alias("prefix")).agg(F.count("*").alias("n"))


def case_duplicates(df, col: str) -> DataFrame:
    """set_case_duplicates: rows whose upper-cased value occurs more than once."""
    up = df.withColumn("_u", F.upper(col))
    repeated = up.groupBy("_u").agg(F.count("*").alias("_n")).where("_n > 1").select("_u")
    return up.join(repeated, "_u", "left_semi").drop("_u")


def remove_common_sequences(rows, seq: str, label: str, order: str) -> DataFrame:
    """set_common_seq_removal: sequences of more than one class vanish, of the others the first row stays."""
    first = F.min_by(F.struct(*[c for c in rows.columns if c != seq]), order).alias("_r")
    one = rows.groupBy(seq).agg(F.min(label).alias("_a"), F.max(label).alias("_b"), first).where("_a = _b")
    return one.select(seq, "_r.*")


def dedup_first(rows, keys: list[str], order: str) -> DataFrame:
    """set_dedup_interval: first row per key, combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def add_controls(pred_expr, pred_obs, expr, obs, col="perturbation", control=CONTROL, renamed="non-targeting"):
    """set_with_controls: predictions plus train control cells, controls renamed; unequal gene sets are an error."""
    controls = obs.where(F.col(col) == control)
    cells = pred_obs.select("cell_id", col).unionByName(controls.select("cell_id", F.lit(renamed).alias(col)))
    a, b = pred_expr.select("gene"), expr.select("gene")
    marks = a.select("gene", F.lit(1).alias("m")).unionByName(b.select("gene", F.lit(2).alias("m")))
    odd = marks.groupBy("gene").agg(F.bit_or("m").alias("m")).where("m <> 3").select(F.count("*")).scalar()
    rows = pred_expr.select("cell_id", "gene", "value").unionByName(
        expr.join(controls.select("cell_id"), "cell_id", "left_semi").select("cell_id", "gene", "value"))
    ok = F.when(odd > 0, F.raise_error(F.lit("gene sets differ"))).otherwise(F.lit(True))
    return rows.where(ok), cells


def eval_subset(obs, col="perturbation", split="split", control=CONTROL, renamed="non-targeting") -> DataFrame:
    """set_eval_subset: control or test rows, control renamed."""
    keep = obs.where((F.col(col) == control) | (F.col(split) == "test"))
    return keep.withColumn(col, F.when(F.col(col) == control, renamed).otherwise(F.col(col)))


def join_attributions(rows, order: str) -> DataFrame:
    """set_attr_join: one score per (gene, sample), the first of repeats; long form of the outer join."""
    return rows.groupBy("gene", "sample_id").agg(F.min_by("score", order).alias("score"))

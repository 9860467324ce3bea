"""Projections and filters on the long matrix and its cell / gene tables (survey section 2.2)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgene.functions.lineage import stable
from tallgene.functions.lists import asking, numbered_pieces, piece_of, pieces_of
from tallgene.functions.ranks import global_quantiles, quantiles_of_columns

CONTROL = "Control"
# Single-cell assays accepted by the "scTab" criteria.
SCTAB_ASSAYS = (
    "10x 3' v1", "10x 3' v2", "10x 3' v3", "10x 3' transcription profiling",
    "10x 5' transcription profiling", "10x 5' v1", "10x 5' v2",
)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _between(col: str, low, high) -> list[Column]:
    out = []
    if low is not None:
        out.append(F.col(col) >= low)
    if high is not None:
        out.append(F.col(col) <= high)
    return out


def filter_cells(expr, min_counts=None, max_counts=None, min_genes=None, max_genes=None) -> DataFrame:
    """flt_cells: keep cells whose totals and number of genes lie inside the given bounds."""
    stats = expr.groupBy("cell_id").agg(F.sum("value").alias("_t"), F.count_if(F.col("value") != 0).alias("_g"))
    keep = stats.where(all_of(_between("_t", min_counts, max_counts) + _between("_g", min_genes, max_genes)))
    return expr.join(keep, "cell_id", "left_semi")


def filter_genes(expr, min_counts=None, max_counts=None, min_cells=None, max_cells=None) -> DataFrame:
    """flt_genes: keep genes whose totals and number of cells lie inside the given bounds."""
    stats = expr.groupBy("gene").agg(F.sum("value").alias("_t"), F.count_if(F.col("value") != 0).alias("_c"))
    keep = stats.where(all_of(_between("_t", min_counts, max_counts) + _between("_c", min_cells, max_cells)))
    return expr.join(keep, "gene", "left_semi")


def keep_genes(expr, genes: DataFrame | None) -> DataFrame:
    """flt_keep_genes: keep listed genes and carry their list position ``pos``; None keeps all."""
    return expr if genes is None else expr.join(genes.select("gene", "pos"), "gene")


def keep_vocab_genes(expr, vocab, field: str = "genes") -> DataFrame:
    """flt_keep_vocab: keep genes that are tokens of a vocabulary field."""
    return expr.join(vocab.where(F.col("field") == field).select(F.col("token").alias("gene")), "gene", "left_semi")


def explain_target_list(explanatory, targets) -> DataFrame:
    """Explanatory genes plus the target genes not already among them; error when every target already is."""
    extra = targets.select("gene").distinct().join(explanatory, "gene", "left_anti")
    n_extra = extra.select(F.count("*")).scalar()
    both = explanatory.select("gene").unionByName(extra).distinct()
    ok = F.when(n_extra == 0, F.raise_error(F.lit("all target genes are already explanatory"))).otherwise(F.lit(True))
    return both.where(ok)


def keep_explanatory_and_targets(expr, explanatory, targets) -> DataFrame:
    """flt_keep_explain_target."""
    return expr.join(explain_target_list(explanatory, targets), "gene", "left_semi")


def limit_to_gene_list(expr, obs, genes) -> tuple[DataFrame, DataFrame]:
    """flt_limit_genes: keep listed genes, then drop cells left without reads."""
    kept = expr.join(genes.select("gene"), "gene", "left_semi")
    return kept, obs.join(kept.where(F.col("value") > 0).select("cell_id"), "cell_id", "left_semi")


def gene_set(keyword: str, vocab, protein_coding, orthologs, l1000) -> DataFrame:
    """flt_gene_set_keyword: the named gene lists; one column ``gene``."""
    if keyword == "tokenizer":
        return vocab.select("gene").distinct()
    if keyword == "protein_coding":
        return protein_coding.select("gene").intersect(vocab.select("gene"))
    if keyword == "orthologs":
        return orthologs.select("gene").distinct()
    if keyword == "L1000":
        return l1000.select("gene").distinct()
    raise ValueError(f"unknown gene list {keyword}")


def query_rows(obs, condition: str) -> DataFrame:
    """flt_query: keep rows that satisfy an SQL predicate."""
    return obs.where(condition)


def filter_terms(obs, terms: dict) -> DataFrame:
    """flt_terms: AND of column == value or column in set; an unknown column is an error."""
    missing = [c for c in terms if c not in obs.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    conds = [
        F.col(c).isin(*sorted(v)) if isinstance(v, (list, tuple, set, frozenset)) else F.col(c) == v
        for c, v in terms.items()
    ]
    return obs.where(all_of(conds))


def limit_to_split(obs, split: str, col: str = "split") -> DataFrame:
    """flt_split."""
    return obs.where(F.col(col) == split)


def census_cells(obs, criteria: str | None = None, split_table=None, split=None, assays=SCTAB_ASSAYS) -> DataFrame:
    """flt_census_criteria: primary data only, optional assay list, optional datasets of one split."""
    out = obs.where(F.col("is_primary_data"))
    if criteria == "scTab":
        out = out.where(F.col("assay").isin(*assays))
    elif criteria is not None:
        raise ValueError(f"unknown criteria {criteria}")
    if split_table is not None:
        wanted = split_table if split is None else split_table.where(F.col("split") == split)
        out = out.join(wanted.select("dataset_id"), "dataset_id", "left_semi")
    return out


def iqr_bounds(df, col: str, scale: float) -> tuple[Column, Column]:
    q = global_quantiles(df, col, {"q1": 0.25, "q3": 0.75})
    iqr = q["q3"] - q["q1"]
    return q["q1"] - F.lit(scale) * iqr, q["q3"] + F.lit(scale) * iqr


def filter_total_iqr(cell_stats, scale: float, col: str = "total_counts") -> DataFrame:
    """flt_iqr_total: keep cells with totals inside Q1 - k*IQR .. Q3 + k*IQR, ends included."""
    cell_stats = stable(cell_stats)
    low, high = iqr_bounds(cell_stats, col, scale)
    return cell_stats.where((F.col(col) >= low) & (F.col(col) <= high))


def filter_outliers(cell_stats, scale: float = 1.5) -> DataFrame:
    """flt_outliers3: IQR rule on log totals, log genes and log mito percentage, all three must hold."""
    logged = stable(cell_stats).withColumns({
        "log_total": F.log1p("total_counts"), "log_genes": F.log1p("n_genes"), "log_mito": F.log1p("pct_mito"),
    })
    qs = quantiles_of_columns(logged, ["log_total", "log_genes", "log_mito"], {"q1": 0.25, "q3": 0.75})
    conds = []
    for c, q in qs.items():
        iqr = q["q3"] - q["q1"]
        conds.append((F.col(c) >= q["q1"] - F.lit(scale) * iqr) & (F.col(c) <= q["q3"] + F.lit(scale) * iqr))
    return logged.where(all_of(conds))


def valid_perturbations(obs, vocab_genes, data_genes, col: str = "perturbation") -> DataFrame:
    """flt_valid_perturbation: all parts known to vocabulary (or Control) and data; parts re-joined sorted."""
    allowed = vocab_genes.select("gene").join(data_genes.select("gene").distinct(), "gene", "left_semi")
    names = obs.select(col).distinct()
    unknown = (
        names.select(col, F.explode(F.split(col, "_")).alias("gene"))
        .where(F.col("gene") != CONTROL).join(allowed, "gene", "left_anti")
    )
    kept = obs.join(unknown.select(col), col, "left_anti")
    return kept.withColumn(col, F.array_join(F.array_sort(F.split(col, "_")), "_"))


def variants_with_keyword(variants, keyword: str = ";COMMON", col: str = "info") -> DataFrame:
    """flt_variant_keyword."""
    return variants.where(F.col(col).contains(keyword))


def drop_all_n(chunks, col: str = "seq") -> DataFrame:
    """flt_all_n_chunk."""
    return chunks.where(~F.col(col).rlike("^N+$"))


def move_targets_to_labels(expr, obs, targets: list[str]) -> tuple[DataFrame, DataFrame]:
    """prj_move_targets: target expression becomes obs columns (zeros included) and leaves the matrix."""
    wide = expr.where(F.col("gene").isin(*targets)).groupBy("cell_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("gene") == t, F.col("value"))), F.lit(0.0)).alias(t) for t in targets]
    )
    labelled = obs.join(wide, "cell_id", "left").fillna(0.0, subset=targets)
    return expr.where(~F.col("gene").isin(*targets)), labelled


def rename_columns(df, drop_regex: str | None = None, strip: str | None = None) -> DataFrame:
    """prj_rename_cols: drop columns that match a pattern, cut a fixed text out of the other names."""
    keep = [c for c in df.columns if not (drop_regex and re.search(drop_regex, c))]
    return df.select(*[F.col(c).alias(c.replace(strip, "") if strip else c) for c in keep])


def use_layer(expr, layer: str) -> DataFrame:
    """prj_layer: take another value column as the matrix."""
    if layer not in expr.columns:
        raise KeyError(layer)
    return expr.select("cell_id", "gene", F.col(layer).alias("value"))


def _dense_lists(expr, cells, genes):
    """Rows (cell_id, ..), the column that lists a piece's genes with the cell's entries and nulls for absent ones, and the number of pieces."""
    listed, n = pieces_of(genes, "gene", distinct=True)
    table = numbered_pieces(listed, n, "gene")
    table = F.broadcast(table) if n == 1 else table  # one row of at most PIECE genes
    others = [c for c in expr.columns if c not in ("cell_id", "gene")]
    keys = ["cell_id"] if n == 1 else ["cell_id", "_piece"]
    own = expr.join(listed, "gene", "left_semi").withColumn("_piece", piece_of(n, "gene"))
    own = own.groupBy(*keys).agg(F.collect_list(F.struct("gene", *others)).alias("_own"))
    asked = asking(cells.select("cell_id"), n).join(own, keys, "left").join(table, ["_piece", "_copy"])
    asked = asked.withColumn("_own", F.coalesce("_own", F.array().cast(own.schema["_own"].dataType)))
    zeros = F.transform(F.array_except("_items.gene", "_own.gene"), lambda g: F.struct(g.alias("gene"), *[F.lit(None).cast(expr.schema[c].dataType).alias(c) for c in others]))
    return asked, F.concat("_own", zeros), n


def dense_rows(expr, cells, genes) -> DataFrame:
    """prj_dense_row: every gene for every cell, absent = 0.

    The gene list is cut into numbered pieces. A cell's entries meet it piece by piece, and the genes that a piece has beyond them are added
    next to them, so that only entries are exchanged and dense rows are made where they are read. With one piece they stay dealt by cell.
    """
    asked, full, _ = _dense_lists(expr, cells, genes)
    return asked.select("cell_id", F.explode(full).alias("_x")).select("cell_id", "_x.*").withColumn("value", F.coalesce("value", F.lit(0.0)))


def dense_samples(expr, cells, genes) -> DataFrame:
    """The dense rows of every distinct cell as one sample (cell_id, items), items in gene order: lists that are never rows in between."""
    asked, full, n = _dense_lists(expr, cells.select("cell_id").distinct(), genes)
    items = F.transform(full, lambda x: F.struct(x["gene"].alias("gene"), F.coalesce(x["value"], F.lit(0.0)).alias("value")))
    lists = asked.select("cell_id", items.alias("items"))
    if n > 1:
        lists = lists.groupBy("cell_id").agg(F.flatten(F.collect_list("items")).alias("items"))
    return lists.select("cell_id", F.sort_array("items").alias("items"))


def order_genes(expr, var, col: str, ascending: bool = False) -> DataFrame:
    """prj_order_genes: per cell, genes and values as arrays ordered by a var column (ties by gene)."""
    key = F.col(col).cast("double")
    items = expr.join(var.select("gene", col), "gene").groupBy("cell_id").agg(
        F.array_sort(F.collect_list(F.struct((key if ascending else -key).alias("k"), "gene", "value"))).alias("items")
    )
    return items.select("cell_id", F.col("items.gene").alias("genes"), F.col("items.value").alias("values"))


def ensembl_check(var) -> DataFrame:
    """prj_ensembl_check: true if more than 8 of the first 10 names are Ensembl ids; error under 10 names."""
    first = var.orderBy("gene_pos").limit(10)
    n = F.count("*")
    hits = F.sum(F.col("gene").rlike("^(ENSG|ENSMUSG)").cast("int"))
    return first.agg(
        F.when(n < 10, F.raise_error(F.lit("fewer than 10 genes"))).otherwise(hits > 8).alias("is_ensembl"),
        F.coalesce(hits, F.lit(0)).cast("bigint").alias("n_match"),
    )


def any_column_contains(df, text: str) -> DataFrame:
    """flt_any_column_contains: rows where any column holds the text, case ignored."""
    cols = F.array(*[F.col(c).cast("string") for c in df.columns])
    return df.where(F.exists(cols, lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())))


def groups_over(df, condition, group: list[str], limit: int, attributes: list[str]) -> DataFrame:
    """flt_group_having: filter, count per group, keep groups over the limit, list their attributes."""
    rows = df.where(condition)
    big = rows.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return rows.select(*group, *attributes).distinct().join(big, group)

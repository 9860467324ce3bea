"""Windows, ranking and top-k (survey section 2.6). Windows by cell are bounded by the number of genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.lineage import stable
from tallgene.functions.ranks import global_quantiles, hash_ranks, value_ranks


def topk_expression(expr, k: int) -> DataFrame:
    """win_topk_expr: the k highest genes of a cell with their position."""
    w = Window.partitionBy("cell_id").orderBy(F.col("value").desc(), "gene")
    return expr.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def sort_numeric_or_text(rows, col: str, descending: bool = True) -> DataFrame:
    """win_sort_numeric_or_text: numeric order if every value of the sample is a number, else text order."""
    num = F.col(col).try_cast("double")
    cell = Window.partitionBy("cell_id")
    tagged = rows.withColumn("_num", num).withColumn("_all", F.count("_num").over(cell) == F.count(F.lit(1)).over(cell))
    keys = [F.when(F.col("_all"), F.col("_num")), F.when(~F.col("_all"), F.col(col))]
    order = [k.desc() if descending else k.asc() for k in keys]
    return tagged.withColumn("pos", F.row_number().over(cell.orderBy(*order, "gene"))).drop("_num", "_all")


def perturbed_first(rows, k: int) -> DataFrame:
    """win_perturbed_first: perturbed genes lead, then by value, so that a cut to k cannot lose them."""
    w = Window.partitionBy("cell_id").orderBy(F.col("perturbed").desc(), F.col("value").desc(), "gene")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def rank_by_total(totals, key: str, total: str) -> DataFrame:
    """win_rank_cells: position by descending total over the whole table (ties in hash order).

    Rank = rows with a larger total (bucketed running counts) + place among equal totals (hash buckets).
    """
    totals = stable(totals)
    above = value_ranks(totals, [], total).select(total, (F.col("n_total") - F.col("n_before") - F.col("n")).alias("_above"))
    tied = hash_ranks(totals, [total], 0, [key], "_place")
    return tied.join(above, total).withColumn("rank", F.col("_above") + F.col("_place")).drop("_above", "_place")


def best_and_worst(gene_errors, k: int, quantile: float = 0.9) -> DataFrame:
    """win_best_worst: of genes over the frequency quantile, the k lowest and k highest mean errors."""
    cut = global_quantiles(gene_errors, "gene_nz_freq", {"c": quantile})["c"]
    common = gene_errors.where(F.col("gene_nz_freq") > cut).withColumn(
        "gene_err_avg", 0.5 * (F.col("gene_err_nz") + F.col("gene_err")))
    err = F.round("gene_err_avg", 9)
    best = common.orderBy(err, "gene").limit(k).withColumn("kind", F.lit("best"))
    worst = common.orderBy(err.desc(), "gene").limit(k).withColumn("kind", F.lit("worst"))
    return best.unionByName(worst).select("kind", "gene", "gene_err_avg")


def letter_runs(tiles, letter: str = "N") -> DataFrame:
    """Runs of one letter inside each tile as [start, end) with flags for touching the tile's edges."""
    runs = F.regexp_extract_all("seq", F.lit(f"({letter}+|[^{letter}]+)"), F.lit(1))
    parts = tiles.select("chrom", "start", F.length("seq").alias("w"), F.posexplode(runs).alias("i", "run"))
    inside = Window.partitionBy("chrom", "start").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({"at": F.coalesce(F.sum(F.length("run")).over(inside), F.lit(0)), "n": F.length("run")})
    return placed.where(F.col("run").startswith(letter)).select(
        "chrom", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + F.col("n")).alias("end"),
        ((F.col("at") == 0) | (F.col("at") + F.col("n") == F.col("w"))).alias("edge"))


def islands(tiles, letter: str = "N", min_length: int = 1) -> DataFrame:
    """win_islands: maximal runs of a letter over a tiled sequence.

    Runs inside a tile are final; only runs that touch a tile edge (at most two per tile) meet in a
    window by chromosome to be merged.
    """
    runs = letter_runs(tiles, letter)
    runs = stable(runs.where(F.col("edge") | (F.col("end") - F.col("start") >= min_length)))
    w = Window.partitionBy("chrom").orderBy("start")
    edge = runs.where("edge").withColumn("_new", F.coalesce((F.col("start") != F.lag("end").over(w)).cast("int"), F.lit(1)))
    grouped = edge.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("chrom", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")
    return runs.where("not edge").drop("edge").unionByName(merged).where(F.col("end") - F.col("start") >= min_length)


def average_ranks(df, by: list[str], col: str) -> DataFrame:
    """win_avg_rank: average rank of every distinct value in its group, with the number of rows that hold it."""
    ranks = value_ranks(df, by, col)
    return ranks.select(*by, col, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank"))


def first_transcripts(gtf, cols: list[str], order: str = "line_no") -> DataFrame:
    """win_first_transcript: per gene the first non-null value of every column, in file order."""
    return gtf.groupBy("gene").agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols
    ])

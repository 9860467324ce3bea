"""Gene-name and label harmonisation through map joins (survey section 2.3).

Map tables are bounded by genes or labels; the join strategy is left to Catalyst, which
broadcasts a side only under its size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.lineage import stable

CONTROL = "Control"


def first_of(df, by: str, *order) -> DataFrame:
    """Keep the first row of every value of ``by``."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")


def rename_genes(expr, var, gene_map=None) -> DataFrame:
    """jn_rename_genes: new names (default: text before ``_ENSG``); first of duplicated names is kept.

    With a map (columns gene, new_name) unmapped genes share the null name, and only the first survives.
    """
    if gene_map is None:
        named = var.select("gene", "gene_pos", F.substring_index("gene", "_ENSG", 1).alias("new_name"))
    else:
        named = var.select("gene", "gene_pos").join(gene_map.select("gene", "new_name"), "gene", "left")
    kept = first_of(named, "new_name", "gene_pos")
    return expr.join(kept.select("gene", "new_name"), "gene").select("cell_id", F.col("new_name").alias("gene"), "value")


def standard_names(var, gene_map, upper: bool = False, threshold: float = 0.3) -> DataFrame:
    """New name per gene; if too small a part of the map is matched the names stay as they are."""
    key = F.upper("gene") if upper else F.col("gene")
    keyed = var.select("gene", "gene_pos", key.alias("name"))
    joined = keyed.join(gene_map.select("name", "symbol"), "name", "left")
    matched = var.join(gene_map.select(F.col("name").alias("gene")), "gene", "left_semi").select(F.count("*")).scalar()
    enough = matched / gene_map.select(F.count("*")).scalar() >= threshold
    return joined.select(
        "gene", "gene_pos", F.when(enough, F.col("symbol")).otherwise(F.col("gene")).alias("new_name"), enough.alias("mapped")
    ).where(F.col("new_name").isNotNull())


def standardize_genes(expr, var, gene_map, strategy: str = "remove", upper: bool = False, threshold: float = 0.3) -> DataFrame:
    """jn_standardize_genes: nomenclature names; duplicates removed, suffixed or summed."""
    named = stable(standard_names(var, gene_map, upper, threshold))
    if strategy == "aggregate":
        joined = expr.join(named.select("gene", "new_name"), "gene")
        return joined.groupBy("cell_id", F.col("new_name").alias("gene")).agg(F.sum("value").alias("value"))
    w = Window.partitionBy("new_name").orderBy("gene_pos")
    ranked = named.withColumn("_k", F.row_number().over(w))
    if strategy == "remove":
        ranked = ranked.where(F.col("_k") == 1)
    elif strategy == "rename":
        again = F.concat_ws("_", "new_name", (F.col("_k") - 1).cast("string"))
        ranked = ranked.where((F.col("_k") == 1) | F.col("mapped")).withColumn(
            "new_name", F.when(F.col("_k") > 1, again).otherwise(F.col("new_name")))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return expr.join(ranked.select("gene", "new_name"), "gene").select("cell_id", F.col("new_name").alias("gene"), "value")


def gene_map_entries(source) -> DataFrame:
    """Every (name, symbol) entry: the symbol itself, then aliases, then previous symbols, in row order."""
    def parts(col: str, prio: int):
        return F.transform(
            F.filter(F.split(F.coalesce(F.col(col), F.lit("")), r"\|"), lambda x: x != ""),
            lambda x: F.struct(x.alias("name"), F.lit(prio).alias("prio")),
        )

    items = F.concat(F.array(F.struct(F.col("symbol").alias("name"), F.lit(0).alias("prio"))),
                     parts("alias_symbol", 1), parts("prev_symbol", 2))
    return source.select("row", "symbol", F.posexplode(items).alias("at", "i")).select("i.name", "symbol", "row", "at", "i.prio")


def build_gene_map(source) -> DataFrame:
    """jn_gene_map_build: one symbol per name, the first entry wins."""
    return gene_map_entries(source).groupBy("name").agg(F.min_by("symbol", F.struct("row", "at")).alias("symbol"))


def gene_map_ambiguity(source) -> DataFrame:
    """jn_gene_map_ambiguity: number of names with 1, 2, 3.. entries, and overlaps of the three name sets."""
    entries = gene_map_entries(source)
    lengths = entries.groupBy("name").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n_names"))
    sets = entries.groupBy("name").agg(F.bit_or(F.expr("shiftleft(1, prio)")).alias("mask"))
    overlaps = sets.groupBy("mask").agg(F.count("*").alias("n_names"))
    return lengths.select(F.lit("entries").alias("kind"), F.col("k").cast("bigint").alias("key"), "n_names").unionByName(
        overlaps.select(F.lit("sets").alias("kind"), F.col("mask").cast("bigint").alias("key"), "n_names"))


def ortholog_table(raw) -> DataFrame:
    """One-to-one, high-confidence, complete ortholog pairs."""
    return raw.where((F.col("confidence") == 1) & (F.col("type") == "ortholog_one2one")).dropna().select("gene", "ortholog")


def map_orthologs(expr, orthologs) -> DataFrame:
    """jn_orthologs: gene -> ortholog by left join, genes without one stay with a null ortholog to report."""
    return expr.join(orthologs, "gene", "left")


def add_locations(var, locations) -> DataFrame:
    """jn_locations: chromosome and start of every gene."""
    return var.join(locations.select("gene", "chromosome", "start"), "gene", "left")


def symbol_medians(medians, names, how: str = "max") -> DataFrame:
    """jn_medians_symbol: id -> symbol, then max or sum per symbol."""
    fn = {"max": F.max, "sum": F.sum}[how]
    return medians.join(names.where(F.col("symbol").isNotNull()), "gene").groupBy("symbol").agg(fn("median").alias("median"))


def merge_metadata(obs, meta, key: str) -> DataFrame:
    """jn_metadata."""
    return obs.join(meta, key, "left")


def extra_mapping(obs, mapping, col: str, out: str) -> DataFrame:
    """jn_extra_mapping: value -> ontology id column; mapping has columns (value, term)."""
    return obs.join(mapping.select(F.col("value").alias(col), F.col("term").alias(out)), col, "left")


def recode(obs, mapping, col: str, out: str) -> DataFrame:
    """jn_recode_fill: recoded value where mapped, the original elsewhere."""
    joined = obs.join(mapping.select(F.col("value").alias(col), F.col("new").alias("_new")), col, "left")
    return joined.withColumn(out, F.coalesce("_new", col)).drop("_new")


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def clean_plus_names(obs, col: str = "perturbation") -> DataFrame:
    """jn_pert_names_gears: ``A+ctrl`` -> A, ``A+B`` -> A_B, ``ctrl`` -> Control, nulls dropped."""
    c = F.col(col)
    for old, new in (("+ctrl", ""), ("ctrl+", ""), ("+", "_"), ("ctrl", CONTROL)):
        c = _swap(c, old, new)
    return obs.where(F.col(col).isNotNull()).withColumn(col, c)


def clean_guide_names(obs, col: str = "perturbation") -> DataFrame:
    """jn_pert_names_scperturb: cut after the last ``_``, map control patterns, drop ``_only`` and ``*`` rows."""
    c = F.regexp_replace(F.col(col), "_[^_]*$", "")
    c = F.regexp_replace(F.regexp_replace(c, r".+\(mod\)", CONTROL), ".+ctrl", CONTROL)
    return obs.where(F.col(col).isNotNull()).withColumn(col, _swap(c, "_only", "")).where(F.col(col) != "*")


def clean_targeting_names(obs, col: str = "perturbation", control: str = "non-targeting") -> DataFrame:
    """jn_pert_names_replogle (cells): the control label becomes Control."""
    return obs.withColumn(col, F.when(F.col(col) == control, CONTROL).otherwise(F.col(col)))


def unique_names(var, name: str, out: str, sep: str = "-", order: str = "gene_pos") -> DataFrame:
    """Make names unique: the first stays, later ones get -1, -2, .. in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return var.withColumn("_k", k).withColumn(
        out, F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat_ws(sep, F.col(name), (F.col("_k") - 1).cast("string")))
    ).drop("_k")


def reindex_by_best(var, name: str, score: str, order: str = "gene_pos") -> DataFrame:
    """jn_reindex_tiebreak: of genes with the same new name the one with the highest score stays."""
    return first_of(var, name, F.col(score).desc(), order)


def label_dictionary(obs, cols: list[str], stored=None) -> DataFrame:
    """jn_label_dict: distinct non-null labels, sorted, numbered from 0; a stored dictionary is reused."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("label_column"), F.col(c).cast("string").alias("label")) for c in cols]))
    found = obs.select(pairs.alias("p")).select("p.*").where(F.col("label").isNotNull()).distinct()
    if stored is not None:
        found = found.join(stored.select("label_column"), "label_column", "left_anti")
    w = Window.partitionBy("label_column").orderBy("label")
    fresh = found.withColumn("label_id", F.row_number().over(w) - 1)
    return fresh if stored is None else fresh.unionByName(stored.select("label_column", "label", "label_id"))


def decode_labels(pred, dictionary, id_col: str, out: str) -> DataFrame:
    """jn_label_decode: predicted ids to names."""
    return pred.join(dictionary.select(F.col("label_id").alias(id_col), F.col("label").alias(out)), id_col)


def general_cell_type(obs, terms, closure, high_level, names, col: str = "cell_type") -> DataFrame:
    """jn_general_cell_type: label -> term -> high-level ancestor's name; a label without a term stays itself.

    ``closure`` holds (ancestor, node, dist) with self pairs; the nearest listed ancestor is used.
    """
    up = closure.join(high_level.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    best = up.groupBy(F.col("node").alias("id")).agg(F.min_by("ancestor", F.struct("dist", "ancestor")).alias("top"))
    mapped = terms.join(best, "id", "left").withColumn("top", F.coalesce("top", "id"))
    labelled = mapped.join(names.select(F.col("id").alias("top"), F.col("name").alias("general")), "top", "left")
    joined = obs.join(labelled.select(F.col("label").alias(col), "general"), col, "left")
    return joined.withColumn("general", F.coalesce("general", col))


def align_embeddings(cells, emb, key: str = "cell_id") -> DataFrame:
    """jn_embed_align: one vector per cell; a cell without a vector is an error."""
    joined = cells.join(emb, key, "left")
    msg = F.concat(F.lit("no embedding for "), F.col(key).cast("string"))
    return joined.withColumn("vec", F.when(F.col("vec").isNull(), F.raise_error(msg)).otherwise(F.col("vec")))


def concat_embeddings(a, b, key: str) -> DataFrame:
    """jn_embed_concat: vectors of ids present in both, joined end to end."""
    right = b.select(key, F.col("vec").alias("_v"))
    return a.select(key, "vec").join(right, key).select(key, F.concat("vec", "_v").alias("vec"))


def merge_results(reference, results, key: str, suffix: str = "_model") -> DataFrame:
    """jn_merge_results: left join of result columns, clashing names get a suffix."""
    renamed = results.select(*[
        F.col(c) if c == key else F.col(c).alias(c + suffix if c in reference.columns else c) for c in results.columns
    ])
    return reference.join(renamed, key, "left")

"""Readers and writers (survey section 2.1). Text formats are read as distributed lines, never as one string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgene.functions.lineage import stable
from tallgene.functions.ranks import hash_ranks, value_ranks
from tallgene.operators.metrics import softmax
from tallgene.operators.sequence import cleanup

LINES_PER_BUCKET = 4096


def read_expression(spark: SparkSession, path: str, cell: str = "cell_id", gene: str = "gene", value: str = "value") -> DataFrame:
    """src_expr_parquet: long matrix; stored zeros drop out (only the three columns are scanned)."""
    return spark.read.parquet(path).where(F.col(value) != 0).select(
        F.col(cell).cast("string").alias("cell_id"), F.col(gene).cast("string").alias("gene"), F.col(value).cast("double").alias("value"))


# numbered text lines ---------------------------------------------------------------------------------

def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their global number over the files in path order: (line_no, value).

    A file split is one contiguous run of rows, so the place inside it comes from
    monotonically_increasing_id; only the table of splits is summed over in order.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                                       F.monotonically_increasing_id().alias("m"))
    splits = raw.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("m").alias("m0"))
    earlier = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("f", "b", "m0", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("off"))
    return raw.join(offsets, ["f", "b"]).select((F.col("off") + F.col("m") - F.col("m0")).alias("line_no"), "value")


#: Summaries that one task scans; three levels of it number more buckets than a long can.
FAN = 1 << 17


def carried(last: DataFrame, levels: int = 3) -> DataFrame:
    """(_bk, _carry): the last non-null ``_last`` of the buckets before each, of (_bk, _last).

    Buckets fall into runs of FAN. A run is scanned in a task of its own, its own last value is the summary that the same scan carries over
    runs, and so on: no task sees more than FAN rows, whatever the length of the input.
    """
    inside = Window.partitionBy("_run").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    dealt = last.withColumn("_run", F.floor(F.col("_bk") / FAN))
    here = dealt.withColumn("_carry", F.last("_last", ignorenulls=True).over(inside))
    if levels == 1:
        return here.select("_bk", "_carry")
    runs = dealt.groupBy("_run").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_bk"))).alias("_last"))
    above = carried(runs.select(F.col("_run").alias("_bk"), "_last"), levels - 1).select(F.col("_bk").alias("_run"), F.col("_carry").alias("_above"))
    return here.join(above, "_run").select("_bk", F.coalesce("_carry", "_above").alias("_carry"))


def carry_forward(rows, order: str, value: str) -> DataFrame:
    """Last non-null ``value`` at or before every row in ``order``: first over buckets of rows, then inside each bucket."""
    bucketed = rows.withColumn("_bk", F.floor(F.col(order) / LINES_PER_BUCKET))
    summaries = stable(bucketed.groupBy("_bk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last")))
    carry = carried(summaries)
    inside = Window.partitionBy("_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return bucketed.join(carry, "_bk").withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carry")).drop("_bk", "_carry")


def running_offset(rows, group: str, order: str, size: Column) -> DataFrame:
    """Sum of ``size`` over earlier rows of the group as ``offset``, in two levels like :func:`carry_forward`."""
    sized = rows.withColumns({"_bk": F.floor(F.col(order) / LINES_PER_BUCKET), "_sz": size})
    buckets = sized.groupBy(group, "_bk").agg(F.sum("_sz").alias("_t"))
    before = Window.partitionBy(group).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(group, "_bk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(group, "_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sized.join(starts, [group, "_bk"]).withColumn("offset", F.col("_o") + F.coalesce(F.sum("_sz").over(inside), F.lit(0))).drop("_bk", "_sz", "_o")


def write_lines(rows, path: str, *order: str) -> None:
    """Rows (value, order..) as text files whose names follow the order."""
    rows.orderBy(*order).select("value").write.text(path)


# single-cell text triple -----------------------------------------------------------------------------

def read_10x(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """src_10x_text: matrix.mtx, features.tsv and barcodes.tsv; a two-column features file gets its type column."""
    parts = F.split("value", "\t")
    features = numbered_lines(spark, f"{folder}/features.tsv").select(
        (F.col("line_no") + 1).alias("gi"), F.get(parts, F.lit(0)).alias("gene"), F.get(parts, F.lit(1)).alias("symbol"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("Gene Expression")).alias("feature_type"))
    barcodes = numbered_lines(spark, f"{folder}/barcodes.tsv").select((F.col("line_no") + 1).alias("ci"), F.col("value").alias("cell_id"))
    lines = numbered_lines(spark, f"{folder}/matrix.mtx").where(~F.col("value").startswith("%"))
    head = lines.select(F.min("line_no")).scalar()
    f = F.split(F.trim("value"), "\\s+")
    entries = lines.where(F.col("line_no") > head).select(f[0].cast("bigint").alias("gi"), f[1].cast("bigint").alias("ci"), f[2].cast("double").alias("value"))
    expr = entries.join(features.select("gi", "gene"), "gi").join(barcodes, "ci").select("cell_id", "gene", "value")
    return expr, features.select("gene", "symbol", "feature_type")


def write_10x(expr, var, folder: str) -> None:
    """The same triple from a long matrix; genes in name order (bounded), cells in hash order."""
    cells = hash_ranks(expr.select("cell_id").distinct(), [], 0, ["cell_id"], "ci")
    genes = var.select("gene", "symbol").withColumn("gi", F.row_number().over(Window.orderBy("gene")))
    write_lines(genes.select(F.concat_ws("\t", "gene", "symbol").alias("value"), "gi"), f"{folder}/features.tsv", "gi")
    write_lines(cells.select(F.col("cell_id").alias("value"), "ci"), f"{folder}/barcodes.tsv", "ci")
    body = expr.join(genes.select("gene", "gi"), "gene").join(cells, "cell_id").select(
        F.concat_ws(" ", F.col("gi").cast("string"), F.col("ci").cast("string"), F.col("value").cast("string")).alias("value"), F.lit(2).alias("k"), "ci", "gi")
    n = expr.select(F.count("*")).scalar()
    top = expr.sparkSession.range(1)
    sizes = F.concat_ws(" ", genes.select(F.count("*")).scalar().cast("string"), cells.select(F.count("*")).scalar().cast("string"), n.cast("string"))
    zero = F.lit(0).cast("bigint")
    head = top.select(F.lit("%%MatrixMarket matrix coordinate real general").alias("value"), F.lit(0).alias("k"), zero.alias("ci"), zero.alias("gi")).unionByName(
        top.select(sizes.alias("value"), F.lit(1).alias("k"), zero.alias("ci"), zero.alias("gi")))
    write_lines(head.unionByName(body), f"{folder}/matrix.mtx", "k", "ci", "gi")


# delimited files -------------------------------------------------------------------------------------

def read_meta_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""src_meta_csv: headerless CSV with given names, ``\N`` is null."""
    return spark.read.schema(schema).option("nullValue", "\\N").csv(path)


def read_fasta(spark: SparkSession, path: str, width: int, header: str = ">") -> DataFrame:
    """src_fasta: tiles (chrom, tile, start, seq); names are the first word of the header line, letters upper-cased.

    A record can be a whole chromosome: lines find their header by carry-forward and their position by running
    sums, both in two levels, and are cut where they cross tile edges.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value")).where(F.col("value") != "")
    is_head = F.col("value").startswith(header)
    name = F.when(is_head, F.expr(f"substr(split(value, ' ')[0], {len(header) + 1})"))
    body = carry_forward(lines.withColumn("chrom", name), "line_no", "chrom").where(~F.col("value").startswith(header))
    placed = running_offset(body, "chrom", "line_no", F.length("value"))
    first, last = F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.length("value") - 1) / width)
    cut = placed.withColumn("tile", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("tile") * width - F.col("offset"), F.lit(0))
    hi = F.least((F.col("tile") + 1) * width - F.col("offset"), F.length("value"))
    piece = F.struct("offset", F.substring(F.col("value"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["s"]), "")
    tiles = cut.groupBy("chrom", "tile").agg(cleanup(F.upper(text)).alias("seq"))
    return tiles.select("chrom", "tile", (F.col("tile") * width).alias("start"), "seq")


def fasta_lines(tiles, line: int) -> DataFrame:
    """Lines of a FASTA export of tiles whose width is a multiple of the line length: (value, chrom, at)."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s)(.{{1,{line}}})"), F.lit(1))
    body = tiles.select("chrom", "start", F.posexplode(pieces).alias("i", "value")).select("value", "chrom", (F.col("start") + F.col("i") * line).alias("at"))
    heads = tiles.select("chrom").distinct().select(F.concat(F.lit(">"), "chrom", F.lit(" exported")).alias("value"), "chrom", F.lit(-1).cast("bigint").alias("at"))
    return heads.unionByName(body)


# The columns of the format.
VCF_COLUMNS = ("contig", "pos", "id", "ref", "alt", "qual", "filter", "info")


def read_vcf(spark: SparkSession, path: str, keyword: str | None = ";COMMON") -> DataFrame:
    """src_vcf_text: variant lines with a keyword in INFO; alternatives as array, INFO also as map."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(*[f[i].alias(c) for i, c in enumerate(VCF_COLUMNS)])
    if keyword:
        rows = rows.where(F.col("info").contains(keyword))
    return rows.withColumns({"pos": F.col("pos").cast("bigint"), "alts": F.split("alt", ","), "info_map": F.str_to_map("info", F.lit(";"), F.lit("="))})


# The columns of the format.
GTF_SCHEMA = "chrom string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attrs string"


def read_gtf(spark: SparkSession, path: str, feature: str = "transcript") -> DataFrame:
    """src_gtf: rows of one feature with the gene name pulled out of the attributes; nameless rows drop out."""
    rows = spark.read.schema(GTF_SCHEMA).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    name = F.regexp_extract("attrs", 'gene_name "([^"]+)"', 1)
    return rows.where(F.col("feature") == feature).withColumn("gene_name", name).where(F.col("gene_name") != "")


def read_dna_csv(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """src_dna_csv: first column is the sequence whatever its name, all strings; split = file name, all when none is asked."""
    rows = spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(f"{path}/{{file=,}}{split or '*'}.csv")
    name = F.regexp_extract(F.input_file_name(), "/(?:file=)?([^/]+)\\.csv", 1)
    return rows.withColumnRenamed(rows.columns[0], "sequence").withColumn("split", name)


def read_fileset(parts: dict[str, tuple[DataFrame, DataFrame]], join_obs: str = "inner") -> tuple[DataFrame, DataFrame]:
    """src_fileset: matrices on their common genes; obs with common ("inner") or all ("outer") columns and a dataset label."""
    genes = reduce(lambda a, b: a.intersect(b), [e.select("gene") for e, _ in parts.values()])
    expr = reduce(lambda a, b: a.unionByName(b), [e.withColumn("dataset", F.lit(n)) for n, (e, _) in parts.items()])
    tables = [o.withColumn("dataset", F.lit(n)) for n, (_, o) in parts.items()]
    if join_obs == "inner":
        common = [c for c in tables[0].columns if all(c in o.columns for o in tables)]
        tables = [o.select(*common) for o in tables]
    obs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return expr.join(genes, "gene", "left_semi"), obs


def read_predictions(spark: SparkSession, folder: str, dims: int, classes: list[str]) -> DataFrame:
    """src_pred_csv: embeddings, predictions, logits and probabilities joined by cell. Plain columns are exchanged, arrays are made behind the joins."""
    def scores(name):
        cols = ", ".join(f"{name}{i} double" for i in range(len(classes)))
        return spark.read.schema(f"cell_id string, {cols}").option("header", True).csv(f"{folder}/{name}.csv").withColumn(f"_{name}", F.lit(True))

    def array(name, n):
        return F.array(*[F.col(f"{name}{i}") for i in range(n)])

    vec = ", ".join(f"e{i} double" for i in range(dims))
    emb = spark.read.schema(f"cell_id string, {vec}").csv(f"{folder}/embeddings.csv")
    pred = spark.read.schema("cell_id string, prediction string").option("header", True).csv(f"{folder}/predictions.csv")
    met = emb.join(pred, "cell_id", "left").join(scores("logits"), "cell_id", "left").join(scores("probabilities"), "cell_id", "left")
    return met.select("cell_id", array("e", dims).alias("embedding"), "prediction", *[
        F.when(F.col(f"_{name}"), array(name, len(classes))).alias(name) for name in ("logits", "probabilities")])


# sinks -----------------------------------------------------------------------------------------------

def write_split(df, path: str, split: str = "split") -> None:
    """snk_parquet_split: one directory per split."""
    df.write.partitionBy(split).parquet(path)


def write_dna_csv(df, path: str, split: str = "split") -> None:
    """What ``read_dna_csv`` reads, all splits in one pass; names must be file names. Each task writes a file for every split it holds."""
    df.withColumn("file", F.concat(split, F.lit(".csv"))).drop(split).write.partitionBy("file").option("header", True).csv(path)


def result_tables(results, dictionary, classes: list[str]) -> dict[str, DataFrame]:
    """snk_results: tables to save from (cell_id, embedding, predicted_id, logits): embeddings, named predictions,
    logits and softmax probabilities."""
    names = dictionary.select(F.col("label_id").alias("predicted_id"), F.col("label").alias("prediction"))

    def wide(col, prefix=""):
        return [F.element_at(col, i + 1).alias(f"{prefix}{c}") for i, c in enumerate(classes)]

    return {
        "embeddings": results.select("cell_id", "embedding"),
        "predictions": results.join(names, "predicted_id").select("cell_id", "prediction"),
        "logits": results.select("cell_id", *wide(F.col("logits"))),
        "probabilities": results.select("cell_id", softmax(F.col("logits")).alias("p")).select("cell_id", *wide(F.col("p"))),
    }


#: Lines of a result file at most: it is compressed, so that one task reads it.
LINES = 1 << 20


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables of :func:`result_tables` as compressed CSV, which any CSV reader of Spark opens by its name."""
    for name, df in tables.items():
        flat = df
        if name == "embeddings":
            dims = df.select(F.max(F.size("embedding"))).first()[0]
            flat = df.select("cell_id", *[F.col("embedding")[i].alias(str(i)) for i in range(dims)])
        flat.write.option("header", name != "embeddings").option("compression", "gzip").option("maxRecordsPerFile", LINES).csv(f"{folder}/{name}.csv")


def chunk_index(rows, row_id: str, size: int) -> DataFrame:
    """snk_chunk_index: chunk number and place of every row id, in id order; the last chunk is short."""
    at = value_ranks(rows, [], row_id).select(row_id, F.col("n_before").alias("position"))
    return at.withColumns({"chunk": F.floor(F.col("position") / size), "place": F.col("position") % size})


def chunk_manifest(index) -> DataFrame:
    """One row per chunk: number of rows and file name."""
    name = F.concat(F.lit("chunk_index"), F.lpad(F.col("chunk").cast("string"), 8, "0"), F.lit(".bin"))
    return index.groupBy("chunk").agg(F.count("*").alias("chunk_size")).withColumn("filename", name)

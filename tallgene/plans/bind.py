"""Domain views over the driver's tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgene.functions.lineage import spread

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TILE = 1024


def _s(c: str):
    return F.col(c).cast("string")


class Tables:
    """Lazy access: ``t.lineitem`` reads parquet, ``t.expr`` is a bound view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @property
    def expr(self):
        """Matrix: order x part, value = summed quantity."""
        return self.lineitem.groupBy(_s("l_orderkey").alias("cell_id"), _s("l_partkey").alias("gene")).agg(
            F.sum("l_quantity").alias("value")
        )

    @property
    def obs(self):
        """Cells that have reads, with label, batch and donor."""
        has = self.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
        return self.orders.join(has, "o_orderkey", "left_semi").select(
            _s("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("label"),
            F.col("o_orderstatus").alias("batch"), _s("o_custkey").alias("donor"),
            F.col("o_totalprice").alias("score"),
        )

    @property
    def var(self):
        return self.part.select(
            _s("p_partkey").alias("gene"), F.col("p_partkey").alias("gene_pos"), F.col("p_name").alias("symbol"),
            F.col("p_brand").alias("grp"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"),
            F.col("p_retailprice").alias("price"), F.col("p_name").startswith("red").alias("mito"),
        )

    @property
    def bexpr(self):
        """Dense-ish matrix: supplier x brand."""
        p = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
        return self.lineitem.join(p, "l_partkey").groupBy(_s("l_suppkey").alias("cell_id"), "gene").agg(
            F.sum("l_quantity").alias("value")
        )

    @property
    def bobs(self):
        return self.supplier.select(
            _s("s_suppkey").alias("cell_id"),
            F.concat(F.lit("N"), _s("s_nationkey")).alias("label"),
            (F.col("s_suppkey") % 3).alias("batch"),
        )

    @property
    def pexpr(self):
        """Perturbation matrix: order x brand."""
        p = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
        return self.lineitem.join(p, "l_partkey").groupBy(_s("l_orderkey").alias("cell_id"), "gene").agg(
            F.sum("l_quantity").alias("value")
        )

    @property
    def pobs(self):
        """Cells with a perturbation: Control, one brand, or two brands joined by ``_``."""
        c = F.col("o_custkey")
        a, b = c % 25 + 1, F.floor(c / 25) % 25 + 1
        one = F.concat(F.lit("Brand#"), a.cast("string"))
        two = F.concat(one, F.lit("_Brand#"), b.cast("string"))
        pert = F.when(c % 8 == 0, "Control").when((c % 3 == 0) & (a != b), two).otherwise(one)
        return self.orders.select(
            _s("o_orderkey").alias("cell_id"), pert.alias("perturbation"),
            F.col("o_orderstatus").alias("batch"), F.col("o_orderpriority").alias("cell_type"),
        )

    @property
    def pred(self):
        """Field predictions: one row per (sample, gene) with label, prediction and a zero logit."""
        ln = F.col("l_linenumber")
        return self.lineitem.select(
            F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber")).alias("sample_id"),
            F.concat(F.lit("S"), _s("l_suppkey")).alias("gene"),
            F.when(ln % 4 == 0, F.lit(0.0)).otherwise(F.col("l_quantity")).alias("label"),
            F.when(F.col("l_discount") < 0.015, F.lit(0.0)).otherwise(F.col("l_extendedprice") / 1700).alias("predicted"),
            F.round(F.col("l_discount") * 100 - 5).alias("logit_zero"),
        )

    @property
    def cpred(self):
        """Class predictions: label, predicted class and three logits."""
        a, n, rr = F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50
        best = F.when((a >= n) & (a >= rr), "A").when(n >= rr, "N").otherwise("R")
        return self.lineitem.select(
            F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")).alias("sample_id"),
            F.col("l_returnflag").alias("label"), best.alias("predicted"),
            a.alias("logit_a"), n.alias("logit_n"), rr.alias("logit_r"),
        )

    @property
    def seqs(self):
        """Sequences over A C G T N."""
        clean = F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "N")
        return spread(self.documents.select("doc_id", "text"), "doc_id").select(F.concat(F.lit("d"), _s("doc_id")).alias("chrom"), clean.alias("seq"))

    @property
    def tiles(self):
        """The same sequences as tiles of a fixed width."""
        from tallgene.operators.sequence import to_tiles

        return to_tiles(self.seqs, TILE)

    @property
    def emb(self):
        return self.embeddings.select(
            "vec_id", "label", (F.col("vec_id") % 3).alias("batch"),
            F.col("embedding").cast("array<double>").alias("vec"),
        )

    @property
    def signal(self):
        """Signal track: ten-base intervals with a value on 25 chromosomes."""
        return self.events.select(
            F.concat(F.lit("c"), (F.col("user_id") % 25).cast("string")).alias("chrom"),
            (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 10).alias("end"), "value",
        )


_VIEWS = {
    "expr": """SELECT CAST(l_orderkey AS VARCHAR) AS cell_id, CAST(l_partkey AS VARCHAR) AS gene,
        sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2""",
    "obs": """SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, o_orderpriority AS label, o_orderstatus AS batch,
        CAST(o_custkey AS VARCHAR) AS donor, o_totalprice AS score FROM orders
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "var": """SELECT CAST(p_partkey AS VARCHAR) AS gene, p_partkey AS gene_pos, p_name AS symbol, p_brand AS grp,
        p_type AS kind, p_size AS size, p_retailprice AS price, p_name LIKE 'red%' AS mito FROM part""",
    "bexpr": """SELECT CAST(l_suppkey AS VARCHAR) AS cell_id, p_brand AS gene, sum(l_quantity) AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "bobs": """SELECT CAST(s_suppkey AS VARCHAR) AS cell_id, 'N' || s_nationkey AS label, s_suppkey % 3 AS batch
        FROM supplier""",
    "pexpr": """SELECT CAST(l_orderkey AS VARCHAR) AS cell_id, p_brand AS gene, sum(l_quantity) AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "pobs": """SELECT CAST(o_orderkey AS VARCHAR) AS cell_id,
        CASE WHEN o_custkey % 8 = 0 THEN 'Control'
             WHEN o_custkey % 3 = 0 AND o_custkey % 25 <> (o_custkey // 25) % 25
             THEN 'Brand#' || (o_custkey % 25 + 1) || '_Brand#' || ((o_custkey // 25) % 25 + 1)
             ELSE 'Brand#' || (o_custkey % 25 + 1) END AS perturbation,
        o_orderstatus AS batch, o_orderpriority AS cell_type FROM orders""",
    "pred": """SELECT l_orderkey || '-' || l_linenumber AS sample_id, 'S' || l_suppkey AS gene,
        CASE WHEN l_linenumber % 4 = 0 THEN 0.0::DOUBLE ELSE l_quantity END AS label,
        CASE WHEN l_discount < 0.015 THEN 0.0::DOUBLE ELSE l_extendedprice / 1700 END AS predicted,
        round(l_discount * 100 - 5) AS logit_zero FROM lineitem""",
    "cpred": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS sample_id, l_returnflag AS label,
        CASE WHEN l_discount * 10 >= l_tax * 12 AND l_discount * 10 >= l_quantity / 50 THEN 'A'
             WHEN l_tax * 12 >= l_quantity / 50 THEN 'N' ELSE 'R' END AS predicted,
        l_discount * 10 AS logit_a, l_tax * 12 AS logit_n, l_quantity / 50 AS logit_r FROM lineitem""",
    "seqs": """SELECT 'd' || doc_id AS chrom,
        regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM documents""",
    "emb": """SELECT vec_id, label, vec_id % 3 AS batch, embedding::DOUBLE[] AS vec FROM embeddings""",
    "embl": """SELECT vec_id, label, vec_id % 3 AS batch, unnest(embedding)::DOUBLE AS x,
        generate_subscripts(embedding, 1) AS dim FROM embeddings""",
    "signal": """SELECT 'c' || (user_id % 25) AS chrom, event_id * 10 AS start, event_id * 10 + 10 AS "end", value
        FROM events""",
}


def views(*names: str) -> str:
    """``WITH`` clause that defines the named views for the SQL side."""
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in names) + "\n"

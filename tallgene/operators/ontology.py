"""Label ontology graphs (survey section 2.15): nodes (id, name, ..) and edges (parent, child)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgene.functions.lineage import stable
from tallgene.functions.ranks import meet


#: Rows below one node that meet in a task.
BELOW = 1 << 16


def _longer(front, tails) -> DataFrame:
    """Paths of ``front`` carried on by those of ``tails``. A node with many rows below it is dealt in parts of about BELOW rows."""
    # of n tails at most n / BELOW nodes are heavy, so this list is short whatever the ontology
    heavy = F.broadcast(stable(tails.groupBy("ancestor").agg(F.ceil(F.count("*") / BELOW).alias("_parts")).where("_parts > 1")))
    parts = F.coalesce("_parts", F.lit(1))
    up = front.join(heavy.withColumnRenamed("ancestor", "node"), "node", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    down = tails.join(heavy, "ancestor", "left").select(
        F.col("ancestor").alias("node"), F.col("node").alias("far"), F.col("dist").alias("d2"), F.pmod(F.xxhash64("node"), parts).alias("_part"))
    return up.join(down, ["node", "_part"]).select("ancestor", F.col("far").alias("node"), (F.col("dist") + F.col("d2")).alias("dist"))


def closure(nodes, edges) -> DataFrame:
    """(ancestor, node, dist) with self pairs, by path doubling: log2(depth) rounds, each checkpointed.

    A shortest path of more than n and at most 2n steps is one of exactly n steps and one of 1 to n, so a round joins only
    these and adds only pairs that are new.
    """
    self_pairs = nodes.select(F.col("id").alias("ancestor"), F.col("id").alias("node"), F.lit(0).alias("dist"))
    steps = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("dist"))
    paths = stable(self_pairs.unionByName(steps).groupBy("ancestor", "node").agg(F.min("dist").alias("dist")))
    reach = 1
    while True:
        found = _longer(paths.where(F.col("dist") == reach), paths.where(F.col("dist").between(1, reach)))
        new = stable(meet(found.groupBy("ancestor", "node").agg(F.min("dist").alias("dist")), paths.select("ancestor", "node"), ["ancestor", "node"], "left_anti"))
        if new.isEmpty():
            return paths
        paths, reach = paths.unionByName(new), 2 * reach


def leaves(nodes, edges) -> DataFrame:
    """ont_leaves: nodes without children, sorted, numbered from 0.

    Ids are dealt by ranges; a range is numbered from the sum of the counts of those before it, so leaves are many tasks.
    """
    out = nodes.select("id").join(edges.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    dealt = stable(out.repartitionByRange("id").withColumn("_range", F.spark_partition_id()))
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", first.alias("_first"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("id")) - 1
    return dealt.join(offsets, "_range").select("id", (nth + F.col("_first")).cast("int").alias("label_id"))


def find_leaves(paths, leaf_table, node) -> DataFrame:
    """ont_find_leaves: leaves reachable from the given nodes (a leaf reaches itself, an unknown node nothing)."""
    return node.select(F.col("id").alias("ancestor")).join(paths, "ancestor").join(
        leaf_table.select(F.col("id").alias("node")), "node", "left_semi").select("ancestor", F.col("node").alias("leaf"))


def build(terms, superclasses, unknown_id: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """ont_build: without obsolete terms and the unknown id; edges parent -> child between kept terms."""
    nodes = stable(terms.where(~F.col("obsolete") & (F.col("id") != unknown_id)).select("id", F.coalesce("name", F.lit("")).alias("name")))
    ids = nodes.select("id")
    edges = superclasses.where(F.col("parent") != F.col("child")).join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").join(
        ids.withColumnRenamed("id", "child"), "child", "left_semi").select("parent", "child").distinct()
    return nodes, stable(edges)


def prune_dead_leaves(nodes, edges, paths, observed) -> tuple[DataFrame, DataFrame]:
    """ont_prune_dead_leaves: keep nodes that reach an observed id (closed form of removing dead leaves again and again)."""
    alive = paths.join(observed.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    kept = nodes.join(alive, "id", "left_semi")
    linked = edges.join(alive.withColumnRenamed("id", "parent"), "parent", "left_semi").join(alive.withColumnRenamed("id", "child"), "child", "left_semi")
    return kept, linked


def missing_ids(observed, nodes) -> DataFrame:
    """ont_coverage (report): observed ids that the ontology does not have."""
    return observed.select("id").distinct().join(nodes.select("id"), "id", "left_anti")


def check_coverage(observed, nodes) -> DataFrame:
    """ont_coverage (check): the observed ids; any id missing from the ontology is an error."""
    joined = observed.select("id").distinct().join(nodes.select("id", F.lit(True).alias("_known")), "id", "left")
    msg = F.concat(F.lit("not in the ontology: "), "id")
    return joined.select(F.when(F.col("_known").isNull(), F.raise_error(msg)).otherwise(F.col("id")).alias("id"))

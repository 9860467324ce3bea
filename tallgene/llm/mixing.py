"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``target`` of each row of (source, source_size): its weight's share of all sizes, at most ``cap`` times its own.

    Sources in code-point order, null last, take the weights in turn. What a full source cannot take goes to the others
    by weight; the level all of them reach is the largest of the levels that fill any run of the smallest sources.
    One row a source is all that these windows see.
    """
    order = W.Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    by_fill = W.Window.orderBy("_fill", F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("_fill", cap * F.col("source_size") / F.col("_weight"))
    full = F.coalesce(F.sum(cap * F.col("source_size")).over(by_fill.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(by_fill.rowsBetween(0, W.Window.unboundedFollowing))
    every = W.Window.partitionBy()
    level = weighed.withColumn("_level", (F.sum("source_size").over(every) - full) / rest)
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("_weight") * F.max("_level").over(every))
    return level.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, *, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, keep: tuple[str, ...] = ("doc_id",),
    text: str = "text", key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """``keep`` columns with ``size`` (words), ``source_size``, ``target``, ``taken`` (words taken, repeats counted),
    ``epochs`` (whole passes) and ``cut`` (words of the last, partial pass).

    A source's documents stand in the order of md5(seed|key), then key and size. With a budget of floor(target) words it
    takes budget div source_size whole passes; the last pass takes documents in that order and cuts the one that crosses
    the rest of the budget, so a source's taken words are its budget exactly. The order depends on keys alone, so reruns agree.

    Words are counted once for sums of (source, 4096 ranges of the hash) and once for the result; the sums of a source's
    earlier ranges are joined back, and only one range of one source meets in a task. A null text has size 0; a null
    source is a source; null keys share one hash; repeated rows are documents of their own. Empty texts take nothing but
    count in whole passes. Columns outside ``keep`` are not read, an empty table gives an empty one.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = docs.select(
        F.struct(*keep).alias("_row"), F.col(key).alias("_id"), F.col(source).alias("_source"), n_words(F.col(text)).alias("size"), hashed.alias("_hash"),
    ).withColumns({"_of": F.coalesce(F.concat(F.lit("="), F.col("_source").cast("string")), F.lit("")), "_range": F.substring("_hash", 1, 3)})
    sums = sized.groupBy("_of", "_range").agg(F.sum("size").alias("_sum"), F.first("_source").alias("source"))
    earlier = W.Window.partitionBy("_of").orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sums.select("_of", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    sizes = sums.groupBy("_of").agg(F.sum("_sum").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes.select("source", "source_size"), weights, cap)
    targets = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_of"), "source_size", "target")
    inside = W.Window.partitionBy("_of", "_range").orderBy("_hash", "_id", "size").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    placed = sized.withColumn("_before", F.sum("size").over(inside) - F.col("size")).join(offsets.join(targets, "_of"), ["_of", "_range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("_earlier") - F.col("_before")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    return placed.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in keep], "size", "source_size", "target", (epochs * F.col("size") + cut).alias("taken"), epochs.alias("epochs"), cut.alias("cut"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each whole pass and one for a cut document with its first ``cut`` words.

    Same columns as ``docs``. Texts without words stay once, as they take nothing of any budget.
    """
    plan = mix(docs.select(F.struct(*docs.columns).alias("_doc"), *[F.col(c).alias(f"_{c}") for c in ("doc_id", "text", "source")]), keep=("_doc",), key="_doc_id", text="_text", source="_source", **options)
    whole = F.when(F.col("size") > 0, F.col("epochs") + (F.col("cut") == F.col("size")).cast("long")).otherwise(1)
    copies = F.array_repeat(F.lit(-1).cast("long"), whole.cast("int"))
    part = F.when((F.col("cut") > 0) & (F.col("cut") < F.col("size")), F.array("cut")).otherwise(F.array().cast("array<bigint>"))
    rows = plan.select("_doc", F.explode(F.concat(copies, part)).alias("_words"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("_doc.text"), F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("_words"), F.lit(0)).cast("int")), " ")
    text = F.when(F.col("_words") < 0, F.col("_doc.text")).otherwise(head)
    fields = {c: F.col(f"_doc.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("_words") < 0, F.col("_doc.n_chars")).otherwise(F.length(head)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[fields[c].alias(c) for c in docs.columns])


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM sources),
filled AS (SELECT *, 3 * source_size / w AS fill FROM weighed),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT)
      - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM filled),
targets AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * max(level) OVER ()) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target, epochs, greatest(0, least(size, budget - epochs * source_size - before)) AS cut,
  epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS taken
FROM passes
"""

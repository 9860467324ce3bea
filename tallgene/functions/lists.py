"""Every row next to every item of a list (genes, labels, changed values), whatever the length of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgene.functions.lineage import stable

#: Items of a piece, and how many copies of a piece share the rows that meet it.
PIECE, COPIES = 4096, 16
#: Arrays of at most so many items are read through.
SHORT = 64


def pieces_of(items: DataFrame, *cols: str, distinct: bool = False) -> tuple[DataFrame, int]:
    """The columns ``cols`` of a list, with ``distinct`` their distinct values that are not null, and the number of its pieces."""
    listed = items.select(*cols)
    listed = stable(listed.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)).distinct() if distinct else listed)
    return listed, max(1, -(-listed.count() // PIECE))


def piece_of(n: int, *cols: str) -> Column:
    """Number of the piece that holds the item ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(n).cast("long"))


def _copies(n: int) -> int:
    return 1 if n == 1 else COPIES


def numbered_pieces(listed: DataFrame, n: int, *cols: str) -> DataFrame:
    """The list as (_piece, _copy, _items)."""
    pieces = listed.groupBy(piece_of(n, *cols).alias("_piece")).agg(F.collect_list(F.struct(*cols)).alias("_items"))
    return pieces.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(_copies(n) - 1))))


def asking(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` once for every piece, with ``_piece`` and the ``_copy`` of it that they meet."""
    return rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("_copy", F.pmod(F.xxhash64(*rows.columns), F.lit(_copies(n))).cast("int"))


def beside(rows: DataFrame, items: DataFrame, *cols: str, distinct: bool = False) -> DataFrame:
    """``rows`` with the columns ``cols`` of every row of ``items``; with ``distinct`` of their distinct values that are not null.

    The list is a table of numbered pieces of about PIECE items. A row asks for every piece by number and meets it by an equi join, so no
    value is longer than a piece; a piece has copies, of which a row meets one, so that no task gets all rows of a piece. Where the
    list is short, Catalyst broadcasts it. An empty list gives no rows.
    """
    listed, n = pieces_of(items, *cols, distinct=distinct)
    met = asking(rows, n).join(numbered_pieces(listed, n, *cols), ["_piece", "_copy"])
    return met.select(*rows.columns, F.explode("_items").alias("_item")).select(*rows.columns, *[f"_item.{c}" for c in cols])


def halving_steps(values: Column) -> Column:
    """Steps of a search by halving in ``values``, the largest power of two first; computed once an array, see :func:`in_sorted`."""
    top = F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    return F.transform(F.sequence(top, F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int"))


def in_sorted(values: Column, steps: Column, item: Column) -> Column:
    """True if the ascending array holds ``item``; false where either is null. Short arrays are read through, longer ones halved."""
    n = F.size(values)
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(values, at + step - 1) <= item), at + step).otherwise(at))
    return F.coalesce(F.when(n <= SHORT, F.array_contains(values, item)).otherwise(F.get(values, below - 1) == item), F.lit(False))

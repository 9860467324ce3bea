"""Incremental jobs on file sources (survey section 2.16). Every micro-batch writes under its own number, so a
retried batch overwrites itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgene.operators import stats as st


def _run(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest ``version=n`` folder of a versioned table."""
    newest = spark.read.parquet(root).select(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/version={newest}")


def ingest_qc(spark: SparkSession, shards: str, schema: str, var: DataFrame, out: str, checkpoint: str, files_per_batch: int = 2) -> DataFrame:
    """stm_ingest_qc: new expression shards to per-cell QC rows. A cell may be spread over shards: each batch writes sums, which add up on read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(shards)

    def batch(df: DataFrame, number: int) -> None:
        st.qc_cells(df, var).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(stream.writeStream.foreachBatch(batch), checkpoint)
    parts = ("total_counts", "n_genes_by_counts", "total_counts_mt")
    sums = spark.read.parquet(out).groupBy("cell_id").agg(*[F.sum(c).alias(c) for c in parts])
    return sums.withColumn("pct_counts_mt", F.when(F.col("total_counts") != 0, 100.0 * F.col("total_counts_mt") / F.col("total_counts")))


KEYS = ("gene_symbol", "biosample_name")


def merged(rows: DataFrame, keys: Sequence[str], at: str, order: str | None = None) -> DataFrame:
    """One row a key: every feature's newest value that is not null, by ``at``, then ``order``, then the greater value.

    Null keys are keys like others. One shuffle with partial aggregates, no join of old and new.
    """
    features = [c for c in rows.columns if c not in (*keys, at, order)]

    def newest(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(at, *([order] if order else []), F.col(c)))).alias(c)

    kept = [F.max_by(F.col(order), F.struct(at, order)).alias(order)] if order else []
    return rows.groupBy(*keys).agg(*kept, *map(newest, features)) if features or kept else rows.select(*keys).distinct()


def upsert(old: DataFrame | None, new: DataFrame, keys: Sequence[str] = KEYS, order: str | None = None) -> DataFrame:
    """stm_datastore_upsert (batch form): new values win, nulls do not overwrite, missing columns and rows are added.

    A key repeated in an update has the values of the row that is last by ``order``, without one the greatest.
    """
    both = new.withColumn("_at", F.lit(1))
    if old is not None:
        both = old.withColumn("_at", F.lit(0)).unionByName(both, allowMissingColumns=True)
    return merged(both, keys, "_at", order)


class Store:
    """A keyed table in hash buckets, each a base and the updates since: written by bucket, merged on read.

    ``delta/batch=n/bucket=b`` holds the keys of update n that fall into bucket b, ``base/batch=n/bucket=b`` all keys of the bucket up to update n.
    ``manifest/batch=n`` says for every bucket which base and updates make it up after update n; it has ``buckets`` rows. An update writes
    its own rows only, and rewrites a bucket once it has ``compact_after`` updates. All files of an update are a pure function of
    the state before and the update, so that a retry writes them again; older ones stay for readers of an older manifest.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = KEYS, buckets: int = 16, compact_after: int = 4, order: str | None = None):
        self.spark, self.root, self.keys, self.order = spark, root, list(keys), order
        self.buckets, self.compact_after = buckets, compact_after

    def _manifest(self, number: int) -> dict[int, tuple[int, list[int]]]:
        rows = self.spark.read.schema("bucket int, base long, updates array<long>").parquet(f"{self.root}/manifest/batch={number}").collect()
        return {r["bucket"]: (r["base"], list(r["updates"])) for r in rows}

    def _paths(self, state: dict[int, tuple[int, list[int]]]) -> list[str]:
        bases = [f"{self.root}/base/batch={base}/bucket={b}" for b, (base, _) in state.items() if base >= 0]
        return bases + [f"{self.root}/delta/batch={n}/bucket={b}" for b, (_, updates) in state.items() for n in updates]

    def _read(self, state: dict[int, tuple[int, list[int]]]) -> DataFrame:
        """Buckets of ``state``: a base counts as the update that it was made after."""
        paths = self._paths(state)
        parts = []
        for kind in ("base", "delta"):
            own = [p for p in paths if f"/{kind}/" in p]
            if own:
                parts.append(self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.root}/{kind}").parquet(*own))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        return merged(rows.drop("bucket"), self.keys, "batch", self.order)

    def _write(self, rows: DataFrame, path: str) -> None:
        number = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", number).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)

    def apply(self, update: DataFrame, number: int) -> None:
        """Update ``number``, from 0 on, one after the other."""
        state = self._manifest(number - 1) if number else {b: (-1, []) for b in range(self.buckets)}
        path = f"{self.root}/delta/batch={number}"
        self._write(merged(update.withColumn("_at", F.lit(0)), self.keys, "_at", self.order), path)
        written = self.spark.read.parquet(path) if not update.isEmpty() else None
        touched = [r["bucket"] for r in written.select("bucket").distinct().collect()] if written is not None else []
        state |= {b: (state[b][0], [*state[b][1], number]) for b in touched}
        full = {b: s for b, s in state.items() if len(s[1]) >= self.compact_after}
        if full:
            self._write(self._read(full), f"{self.root}/base/batch={number}")
            state |= {b: (number, []) for b in full}
        rows = [(b, base, updates) for b, (base, updates) in sorted(state.items())]
        self.spark.createDataFrame(rows, "bucket int, base long, updates array<long>").write.mode("overwrite").parquet(f"{self.root}/manifest/batch={number}")

    def read(self, number: int | None = None) -> DataFrame:
        """The table after update ``number``, by default the last one."""
        if number is None:
            number = self.spark.read.parquet(f"{self.root}/manifest").agg(F.max("batch")).first()[0]
        state = self._manifest(number)
        if not self._paths(state):
            raise ValueError("no update has had a row")
        return self._read(state)


def datastore_stream(spark: SparkSession, updates: str, schema: str, root: str, checkpoint: str, files_per_batch: int = 1000, **options) -> DataFrame:
    """stm_datastore_upsert: the update files not seen yet, ``files_per_batch`` at a time, go into the :class:`Store` at ``root``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(updates)
    store = Store(spark, root, **options)
    _run(stream.writeStream.foreachBatch(store.apply), checkpoint)
    return store.read()


def running_gene_errors(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str) -> DataFrame:
    """stm_gene_error_running: running error sum and count per gene; the latest version of the small gene table is returned."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    err = F.abs(F.col("predicted") - F.col("label"))
    agg = stream.groupBy("gene").agg(F.sum(err).alias("err_sum"), F.count("*").alias("n"))

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/version={number}")

    _run(agg.writeStream.outputMode("complete").foreachBatch(batch), checkpoint)
    return latest(spark, out).withColumn("gene_err", F.col("err_sum") / F.col("n"))

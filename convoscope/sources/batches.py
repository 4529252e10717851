"""Batch sink and resume: results written per batch, idempotently, and the
batches still to run derived from what is on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batches(df: DataFrame, root: str, batch_col: str = "batch_id") -> None:
    """Write partitioned by batch with dynamic partition overwrite: rerunning a
    batch replaces only that batch (a retried or resumed job is idempotent)."""
    # a batch's rows come together first: one file per batch, not one per task and batch
    rows = df.repartition(batch_col)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col).parquet(root)


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def newest_batch(batches: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Newest batch by number (not by file-name order, where _9 sorts after _10)."""
    return batches.agg(F.max(batch_col).alias("newest_batch"))


def planned_batches(spark: SparkSession, n_sets: int, batch_size: int) -> DataFrame:
    """Batch ids 0..ceil(n/b)-1 with their expected sizes (the last one short)."""
    n_b = (n_sets + batch_size - 1) // batch_size
    b = spark.range(n_b).select(F.col("id").cast("int").alias("batch_id"))
    size = F.least(F.lit(batch_size), F.lit(n_sets) - F.col("batch_id") * batch_size)
    return b.withColumn("expected", size.cast("long"))


def pending_batches(planned: DataFrame, finished_sets: DataFrame, set_col: str = "set_id", batch_col: str = "batch_id") -> DataFrame:
    """Planned batches not fully present in ``finished_sets``: a finished batch
    has all of its expected sets; the rest are rerun from their start (a batch
    that was only partly written is not skipped)."""
    have = finished_sets.groupBy(batch_col).agg(F.countDistinct(set_col).alias("have"))
    done = planned.join(have, batch_col).where(F.col("have") == F.col("expected")).select(batch_col)
    return planned.join(done, batch_col, "left_anti")


def batch_plan(rows: DataFrame, batch: Column, set_col: str, cols: Sequence[str]) -> DataFrame:
    """What the input holds: batch_id, expected (its sets) and a fingerprint of all its rows, which doesn't
    depend on their order.  A changed, added or missing row changes its batch's fingerprint only."""
    row = F.xxhash64(*cols).cast("decimal(38,0)")
    per = rows.groupBy(batch.alias("batch_id"), set_col).agg(F.sum(row).alias("h"), F.count(F.lit(1)).alias("n"))
    total = F.xxhash64(F.sum(F.xxhash64(set_col, "h", "n").cast("decimal(38,0)")))
    return per.groupBy("batch_id").agg(F.count(F.lit(1)).alias("expected"), total.alias("fingerprint"))


def record_batches(plan: DataFrame, written: DataFrame, manifest: str, set_col: str = "set_id") -> None:
    """Append to the manifest the planned batches that are wholly written; call it after the data is.

    An append is one commit: its file appears whole or not at all, and a job that ends before it leaves
    its batches pending."""
    have = written.groupBy("batch_id").agg(F.countDistinct(set_col).alias("have"))
    done = plan.join(have, "batch_id").where(F.col("have") == F.col("expected"))
    done.select("batch_id", "expected", "fingerprint", F.current_timestamp().alias("recorded")).write.mode("append").parquet(manifest)


def pending_by_manifest(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned batches whose newest record is missing or is of another input."""
    newest = manifest.groupBy("batch_id").agg(F.max_by(F.struct("expected", "fingerprint"), "recorded").alias("r"))
    done = newest.select("batch_id", "r.expected", "r.fingerprint")
    return plan.join(done, ["batch_id", "expected", "fingerprint"], "left_anti")


def write_sets_json(members: DataFrame, path: str, keep=("idx", "image"), set_cols=("set_id", "set_type")) -> None:
    """One JSON record per set with its members in index order.  Sets are
    bounded by their size parameter, so one record per set is bounded too."""
    cols = [c for c in keep if c in members.columns]
    rec = members.groupBy(*[c for c in set_cols if c in members.columns]).agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("members")
    )
    rec.write.mode("overwrite").json(path)

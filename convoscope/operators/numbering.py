"""Row numbers in an order, without one task that sees all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoscope.session import shared_path


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with ``name``, its rows' position in that order from 0.

    Range partitions number their own rows and add the rows of the partitions
    before them; the numbered partitions are written to the shared folder, so
    that every later read sees the same numbers.
    """
    path = shared_path(df.sparkSession, "numbered", uuid.uuid4().hex)
    local = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = local.select("*", F.monotonically_increasing_id().alias("_id"), F.spark_partition_id().alias("_part"))
    local.write.parquet(path)
    local = df.sparkSession.read.schema(local.schema).parquet(path)
    # one row per partition
    first = local.groupBy("_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(first.select("_part", "_first", before.alias("_before")))
    out = local.join(first, "_part").withColumn(name, F.col("_id") - F.col("_first") + F.col("_before"))
    return out.drop("_part", "_id", "_first", "_before")

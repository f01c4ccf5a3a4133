"""Consecutive numbers for rows, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(rows: DataFrame, key: str, after: Column, name: str) -> DataFrame:
    """Adds ``name``: ``after`` + 1, 2, 3 ... in the order of (md5(key), key).

    The digest spreads any keys evenly over 4,096 buckets.  Rows are numbered
    within their bucket; what precedes a bucket is summed over the bucket counts.
    """
    marked = rows.withColumn("_md5", F.md5(F.col(key).cast("binary")))
    marked = marked.withColumn("_bucket", F.substring("_md5", 1, 3))
    counts = marked.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_md5", key))
    return (
        marked.join(F.broadcast(offsets), "_bucket")  # 4,096 rows at most
        .withColumn(name, after + F.col("_before") + within)
        .drop("_md5", "_bucket", "_before")
    )

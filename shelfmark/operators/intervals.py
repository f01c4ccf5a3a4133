"""Folders numbered so that "below" is a range of numbers.

Folders are numbered in the order in which a walk enters them.  All that lies below a
folder then has the numbers from its own to its last one, and the total of any sub-tree
is the difference of two running sums.  No row is repeated for its ancestors.

Two marks a folder, where it begins and where it ends, are sorted by range over all
tasks; running sums are taken within a range, and what the ranges before add up to, a row
for each range, is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import SEP, ancestors, tidy_path
from ..functions.paths import folder_of
from .totals import total, total_type

# the last of all characters: behind whatever a folder holds
_END = "\U0010ffff"


def folder_intervals(files: DataFrame, sep: str = SEP) -> DataFrame:
    """(disk_id, folder, first, last, file_count, total_bytes) of every folder.

    Numbers begin with 1 and go on over all disks; a folder's own is ``first``."""
    kind = total_type(files)
    size = total(F.coalesce("size_bytes", F.lit(0)), kind)
    direct = files.groupBy("disk_id", folder_of(tidy_path("path", sep), sep).alias("folder"))
    direct = direct.agg(F.count("*").alias("n"), size.alias("b")).where("folder != ''")
    # a folder without files of its own counts as one that holds none
    above = direct.select("disk_id", F.explode(ancestors("folder", sep)["path"]).alias("folder"))
    empty = above.distinct().select("*", F.lit(0).alias("n"), F.lit(0).alias("b"))
    every = direct.unionByName(empty).groupBy("disk_id", "folder").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    key = F.concat("folder", F.lit(sep))
    begins = every.select("disk_id", "folder", key.alias("key"), F.lit(1).alias("one"), "n", "b")
    ends = every.select("disk_id", "folder", F.concat(key, F.lit(_END)).alias("key"), *[F.lit(0).alias(c) for c in ("one", "n", "b")])
    marks = begins.unionByName(ends)
    ranged = marks.repartitionByRange("disk_id", "key").withColumn("range", F.spark_partition_id())
    summed = ("one", "n", "b")
    here = Window.partitionBy("range").orderBy("disk_id", "key")
    local = ranged.withColumns({f"_{c}": F.sum(c).over(here) for c in summed})
    # as many rows as there are ranges
    sums = ranged.groupBy("range").agg(*[F.sum(c).alias(c) for c in summed])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in summed])
    placed = local.join(F.broadcast(offsets), "range")
    placed = placed.withColumns({f"_{c}": F.col(f"_{c}") + F.col(f"before_{c}") for c in summed})
    begin = F.col("one") == 1
    # a folder's two marks meet again: how much was counted up to its end, less what was
    # before its beginning
    return placed.groupBy("disk_id", "folder").agg(
        F.max(F.when(begin, F.col("_one"))).cast("long").alias("first"),
        F.max(F.when(~begin, F.col("_one"))).cast("long").alias("last"),
        (F.max(F.when(~begin, F.col("_n"))) - F.max(F.when(begin, F.col("_n") - F.col("n")))).cast("long").alias("file_count"),
        (F.max(F.when(~begin, F.col("_b"))) - F.max(F.when(begin, F.col("_b") - F.col("b")))).cast(kind).alias("total_bytes"),
    )


def numbered_files(files: DataFrame, intervals: DataFrame, sep: str = SEP) -> DataFrame:
    """``files`` with ``folder_number``, the number of the folder that holds them."""
    folder = folder_of(tidy_path("path", sep), sep)
    numbers = intervals.select("disk_id", F.col("folder").alias("_folder"), F.col("first").alias("folder_number"))
    return files.withColumn("_folder", folder).join(numbers, ["disk_id", "_folder"]).drop("_folder")


def below(numbered: DataFrame, intervals: DataFrame, disk_id: int, folder: str) -> DataFrame:
    """Files anywhere below a folder: those in its range of numbers."""
    chosen = intervals.where((F.col("disk_id") == disk_id) & (F.col("folder") == folder)).select("first", "last")
    # a folder has one row
    rows = numbered.join(F.broadcast(chosen), F.col("folder_number").between(F.col("first"), F.col("last")))
    return rows.select(*numbered.columns)

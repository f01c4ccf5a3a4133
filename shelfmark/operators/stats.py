"""Totals of the catalog and of each disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blank_if_null, human_size
from ..functions.display import or_else
from .totals import total, total_type


def catalog_totals(files: DataFrame) -> DataFrame:
    """File count and bytes of the whole catalog, one row."""
    return files.agg(
        F.count("*").alias("file_count"),
        F.coalesce(total(F.col("size_bytes"), total_type(files)), F.lit(0)).alias("total_bytes"),
    )


def _with_totals(disks: DataFrame, files: DataFrame) -> DataFrame:
    # files are counted per disk before the join, which then has one row per
    # disk on either side: a disk holding most files costs nothing extra
    size = total(F.col("size_bytes"), total_type(files))
    per_disk = files.groupBy("disk_id").agg(F.count("*").alias("n"), size.alias("b"))
    return disks.join(per_disk, "disk_id", "left").select(
        disks["*"],
        F.coalesce("n", F.lit(0)).alias("file_count"),
        F.coalesce("b", F.lit(0)).alias("total_bytes_catalogued"),
    )


def disk_stats(disks: DataFrame, files: DataFrame) -> DataFrame:
    """Files and bytes of every disk, also of disks without files."""
    return (
        _with_totals(disks, files)
        .select("disk_id", "label", "volume_serial", "file_count", F.col("total_bytes_catalogued").alias("total_bytes"))
        .orderBy("disk_id")
    )


def list_disks(disks: DataFrame, files: DataFrame) -> DataFrame:
    """``disk_stats`` as shown to people: label always filled, readable size."""
    return (
        _with_totals(disks, files)
        .select(
            "disk_id",
            or_else("label", F.lit("(unlabeled)")).alias("label"),
            blank_if_null("description").alias("description"),
            "volume_serial",
            "file_count",
            F.col("total_bytes_catalogued").alias("total_bytes"),
            human_size("total_bytes_catalogued").alias("size_human"),
        )
        .orderBy("disk_id")
    )

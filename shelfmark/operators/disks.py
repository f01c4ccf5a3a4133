"""The disks table: refreshed by scans, edited by people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strip
from ..schemas import DISKS, conform
from .changes import last_row_wins
from .numbering import number_rows


def read_disks(disks: DataFrame) -> DataFrame:
    """Disks of any schema version in the current one."""
    return conform(disks, DISKS)


def upsert_disks(disks: DataFrame, volumes: DataFrame, at: Column) -> DataFrame:
    """Disks after the given volumes were scanned at time ``at``.

    ``volumes`` holds volume_serial, label, filesystem and total_bytes.  A known
    volume gets its filesystem, capacity and scan time refreshed; the label stays
    as people left it.  An unknown one is added under the next free id.
    """
    seen = last_row_wins(
        volumes.select("volume_serial", "label", "filesystem", "total_bytes"),
        ["volume_serial"],
        [F.col("label"), F.col("filesystem"), F.col("total_bytes")],
    )
    fresh = seen.withColumn("_seen", F.lit(True)).alias("v")
    known = disks.alias("d").join(fresh, F.col("d.volume_serial") == F.col("v.volume_serial"), "left")
    again = F.col("v._seen").isNotNull()

    def kept(c: str) -> Column:
        if c in ("filesystem", "total_bytes"):
            return F.when(again, F.col(f"v.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
        if c == "last_scanned":
            return F.when(again, at).otherwise(F.col("d.last_scanned")).alias(c)
        return F.col(f"d.{c}").alias(c)

    refreshed = known.select(*[kept(c) for c in disks.columns])
    top_id = disks.agg(F.coalesce(F.max("disk_id"), F.lit(0)).alias("top")).scalar()
    added = number_rows(
        seen.join(disks.select("volume_serial"), "volume_serial", "left_anti"), "volume_serial", top_id, "disk_id"
    ).withColumns({"first_seen": at, "last_scanned": at, "description": F.lit(None).cast("string")})
    return refreshed.unionByName(added.select(*disks.columns))


def patch_disks(disks: DataFrame, patches: DataFrame) -> DataFrame:
    """Disks after edits of label and description.

    ``patches`` holds seq, disk_id, label and description.  NULL leaves a field
    alone, '' clears it, white space at the ends goes.  Edits apply in the order
    of ``seq``: per disk and field the last one given counts.
    """
    last = patches.groupBy("disk_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in ("label", "description")]
    )
    joined = disks.join(last, "disk_id", "left")
    return joined.select(
        *[
            F.coalesce(strip(f"_{c}"), F.col(c)).alias(c) if c in ("label", "description") else F.col(c)
            for c in disks.columns
        ]
    )


def unknown_patches(disks: DataFrame, patches: DataFrame) -> DataFrame:
    """Edits for disks that do not exist."""
    return patches.join(disks.select("disk_id"), "disk_id", "left_anti").select(*patches.columns)

"""The scans table and the errors of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNNING, COMPLETED, INTERRUPTED, FAILED = "running", "completed", "interrupted", "failed"


def close_stale(scans: DataFrame, disk_id: int, at: Column) -> DataFrame:
    """Scans of a disk still marked running become interrupted at ``at``."""
    stale = (F.col("disk_id") == disk_id) & (F.col("status") == RUNNING)
    return scans.withColumns(
        {
            "finished_at": F.when(stale, at).otherwise(F.col("finished_at")),
            "status": F.when(stale, F.lit(INTERRUPTED)).otherwise(F.col("status")),
        }
    )


def close_stale_disks(scans: DataFrame, starting: DataFrame, at: Column) -> DataFrame:
    """``close_stale`` for every disk named in ``starting``."""
    begun = starting.select("disk_id").distinct().withColumn("_begun", F.lit(True))
    stale = F.col("_begun").isNotNull() & (F.col("status") == RUNNING)
    return (
        scans.join(begun, "disk_id", "left")
        .withColumns(
            {
                "finished_at": F.when(stale, at).otherwise(F.col("finished_at")),
                "status": F.when(stale, F.lit(INTERRUPTED)).otherwise(F.col("status")),
            }
        )
        .select(*scans.columns)
    )


def open_scan(scans: DataFrame, scan_id: int, disk_id: int, root_path: str, at: Column) -> DataFrame:
    """Adds a running scan."""
    kinds = {f.name: f.dataType for f in scans.schema.fields}
    values = {
        "scan_id": F.lit(scan_id),
        "disk_id": F.lit(disk_id),
        "root_path": F.lit(root_path),
        "started_at": at,
        "finished_at": F.lit(None),
        "status": F.lit(RUNNING),
        "files_scanned": F.lit(0),
        "files_failed": F.lit(0),
    }
    row = scans.sparkSession.range(1).select(*[values[c].cast(kinds[c]).alias(c) for c in scans.columns])
    return scans.unionByName(row)


def finish_scan(scans: DataFrame, scan_id: int, scanned: int, failed: int, at: Column, status: str = COMPLETED) -> DataFrame:
    """Closes one scan with its status and counts."""
    this = F.col("scan_id") == scan_id
    values = {
        "finished_at": at,
        "status": F.lit(status),
        "files_scanned": F.lit(scanned).cast("long"),
        "files_failed": F.lit(failed).cast("long"),
    }
    return scans.withColumns({c: F.when(this, v).otherwise(F.col(c)) for c, v in values.items()})


def scan_counts(files: DataFrame, errors: DataFrame) -> DataFrame:
    """Files catalogued and errors met, per scan."""
    good = files.groupBy("scan_id").agg(F.count("*").alias("files_scanned"))
    bad = errors.groupBy("scan_id").agg(F.count("*").alias("files_failed"))
    return good.join(bad, "scan_id", "full_outer").select(
        "scan_id",
        F.coalesce("files_scanned", F.lit(0)).alias("files_scanned"),
        F.coalesce("files_failed", F.lit(0)).alias("files_failed"),
    )


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an ``error_message``."""
    bad = F.col("error_message").isNotNull()
    return rows.where(~bad).drop("error_message"), rows.where(bad)

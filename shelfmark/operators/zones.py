"""Newest-first pages that look only at the zones that can matter.

A zone is a part of the files with known bounds: how many rows, the oldest and the newest
modification time.  The ``k`` newest rows all lie in zones that reach up to a certain
time: take zones by their oldest row, latest first, until they hold ``k`` rows; no row
older than the last zone's oldest can then be on the page.

A page goes on from a key, the last row of the page before: (modified_date, path,
disk_id), newest first, ties by path and disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import top


def newest_first() -> list[Column]:
    return [F.desc("modified_date"), F.asc("path"), F.asc("disk_id")]


def after_key(key: tuple) -> Column:
    """Rows that come after the row with this (modified_date, path, disk_id)."""
    modified, path, disk = (F.lit(k) if not isinstance(k, Column) else k for k in key)
    same = F.col("modified_date") == modified
    later = (F.col("path") > path) | ((F.col("path") == path) & (F.col("disk_id") > disk))
    return (F.col("modified_date") < modified) | (same & later)


def zone_bounds(files: DataFrame, zone: str) -> DataFrame:
    """A row per zone: rows with a time, oldest, newest."""
    return files.groupBy(zone).agg(
        F.count("modified_date").alias("rows"), F.min("modified_date").alias("oldest"), F.max("modified_date").alias("newest")
    )


def zones_of_page(bounds: DataFrame, limit: int, before: Column | None = None) -> DataFrame:
    """Zones that can hold one of the ``limit`` newest rows, or of those up to ``before``.

    Zones are few: their bounds are ordered in one task."""
    at_most = bounds if before is None else bounds.where(F.col("oldest") <= before)
    # of a zone that reaches beyond the key it is not known how many rows lie before it
    sure = F.lit(True) if before is None else F.col("newest") < before
    so_far = F.sum(F.when(sure, F.col("rows")).otherwise(0)).over(Window.orderBy(F.desc("oldest")))
    floor = at_most.withColumn("_rows", so_far).where(F.col("_rows") >= limit).agg(F.max("oldest").alias("_floor"))
    joined = at_most.join(F.broadcast(floor))  # an aggregate without keys is one row
    return joined.where(F.col("_floor").isNull() | (F.col("newest") >= F.col("_floor"))).select(bounds.columns)


def newest_page(files: DataFrame, bounds: DataFrame, zone: str, limit: int, key: tuple | None = None) -> DataFrame:
    """The next ``limit`` rows of ``files``, newest first."""
    zones = zones_of_page(bounds, limit, None if key is None else F.lit(key[0]))
    rows = files.join(zones.select(zone), zone, "left_semi")
    rows = rows if key is None else rows.where(after_key(key))
    return top(rows, newest_first(), limit)
